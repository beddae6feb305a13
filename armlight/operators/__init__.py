"""DataFrame operators: numbering, dimensions, pairing, metrics, lift, training."""
