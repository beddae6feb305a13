"""The replay event by event in plain numpy: what the set-based queries must equal."""

import hashlib

import numpy as np

from armlight.sources import interactions as I


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-z))


def net(layers, x, last_sigmoid=True):
    for k, (matrix, bias) in enumerate(layers):
        x = np.asarray(matrix) @ x + np.asarray(bias)
        if k < len(layers) - 1:
            x = np.maximum(x, 0.0)
    return sigmoid(x) if last_sigmoid else x


def uniform(seed, *parts):
    text = ":".join(str(p) for p in (seed, *parts))
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) / 2**32


class Linear:
    def __init__(self, weights, intercept, link):
        self.w, self.b, self.link = np.array(weights, dtype=float), float(intercept), link

    def __call__(self, x):
        z = x @ self.w + self.b
        return sigmoid(z) if self.link == "logit" else z

    def step(self, x, r):
        """One gradient step on a batch, as the first step of Adam."""
        p = self(x)
        slope = p * (1 - p) if self.link == "logit" else np.ones_like(p)
        factor = 2 * (p - r) * slope
        g_w, g_b = (factor[:, None] * x).mean(axis=0) + 1e-5 * self.w, factor.mean() + 1e-5 * self.b
        self.w = self.w - 1e-4 * g_w / (np.abs(g_w) + 1e-8)
        self.b = self.b - 1e-4 * g_b / (np.abs(g_b) + 1e-8)


def tables(facts):
    """Users and offers in first-seen order, and events in replay order, from pandas facts."""
    facts = facts.sort_values("event_id")
    users = facts[I.USER_COLUMNS].drop_duplicates().reset_index(drop=True)
    offers = facts[I.OFFER_COLUMNS].drop_duplicates().reset_index(drop=True)
    users["user_key"], offers["offer_key"] = users.index, offers.index
    keyed = facts.merge(users, on=I.USER_COLUMNS).merge(offers, on=I.OFFER_COLUMNS)
    return users, offers, keyed.sort_values(["user_key", "event_id"]).reset_index(drop=True)


def replay(users, offers, events, model, size, epochs=1, epsilon=0.0, train=False, best_in_training=True, seed=7, pulled_loss=False):
    """Rows (epoch, batch, reward, loss, regret) of complete batches, event by event."""
    o = offers[I.OFFER_FEATURES].to_numpy()
    u = users[I.USER_FEATURES].to_numpy()
    out = []
    for epoch in range(epochs):
        xs, rs, sums = [], [], np.zeros(3)
        for seq, user in enumerate(events["user_key"], start=1):
            contexts = np.hstack([o, np.tile(u[user], (len(o), 1))])
            preds = np.array([model(x) for x in contexts])
            best = int(preds.argmax())
            arm = best
            if epsilon and not uniform(f"{seed}explore", epoch, seq) > epsilon:
                arm = int(np.floor(uniform(f"{seed}arm", epoch, seq) * len(o)))
            values = np.array([net(I.REWARD_LAYERS, x)[0] for x in contexts])
            r = float(values[arm] >= 0.5)
            pred = preds[arm] if pulled_loss else preds.max()
            sums += [r, abs(r - pred), max(values.max() - values[arm], 0.0)]
            xs.append(contexts[best if best_in_training else arm])
            rs.append(r)
            last = seq == len(events)
            if seq % size == 0 or (train and last):
                if train:
                    model.step(np.array(xs), np.array(rs))
                out.append((epoch, (seq - 1) // size, len(xs), *sums))
                xs, rs, sums = [], [], np.zeros(3)
    return out
