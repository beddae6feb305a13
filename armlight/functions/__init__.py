"""Column functions: hashed random numbers, vectors and model scores."""
