"""The catalog's queries again as SQL over the raw tables, for checking results.

The SQL takes the plain way wherever the DataFrame query has a faster one: it
forms all user-offer pairs, ranks with global windows and repeats nothing from
the staged tables.
"""

from armlight.plans.training_oracles import fit_ctes, net_score_sql, places_ctes
from armlight.sources import interactions as I

_INTER = """inter as (
 select e.event_id, e.user_id, p.p_partkey as offer_id, e.ts as redeem_date, e.event_type, e.value,
  c.c_acctbal/1e4 as u_bal, case when c.c_mktsegment='BUILDING' then 1e0 else 0e0 end as u_bld, c.c_nationkey/25e0 as u_nat,
  p.p_size/5e1 as o_size, p.p_retailprice/1e3 as o_price, case when p.p_type='PROMO' then 1e0 else 0e0 end as o_promo,
  c.c_acctbal/1e2 as tenure_seeds, cast(c.c_nationkey as double) as recency_seeds, e.value as dollars_seeds,
  cast(p.p_size as double) as units_seeds, p.p_retailprice as trips_seeds,
  case when e.value >= 50 then 1 else 0 end as target
 from events e join customer c on e.user_id = c.c_custkey
 join part p on p.p_partkey = cast(regexp_extract(e.props, '([0-9]+)', 1) as bigint))"""

_DIMS = """users as (
 select user_id, u_bal, u_bld, u_nat, row_number() over (order by min(event_id)) - 1 as user_key
 from inter group by user_id, u_bal, u_bld, u_nat),
offers as (
 select offer_id, o_size, o_price, o_promo, row_number() over (order by min(event_id)) - 1 as offer_key
 from inter group by offer_id, o_size, o_price, o_promo),
replay as (
 select row_number() over (order by u.user_key, i.event_id) as seq, i.event_id, u.user_key, o.offer_key, i.target
 from inter i
 join users u on i.user_id = u.user_id and i.u_bal = u.u_bal and i.u_bld = u.u_bld and i.u_nat = u.u_nat
 join offers o on i.offer_id = o.offer_id and i.o_size = o.o_size and i.o_price = o.o_price and i.o_promo = o.o_promo)"""


def _number(value) -> str:
    return f"({value!r}::double)"


def linear_sql(weights=None, intercept=None, names=None) -> str:
    weights = weights or I.POLICY_WEIGHTS
    intercept = I.POLICY_INTERCEPT if intercept is None else intercept
    terms = [f"{_number(w)}*{f}" for f, w in weights.items()]
    return "(" + " + ".join(terms) + f" + {_number(intercept)})"


def sigmoid_sql(z: str) -> str:
    return f"(1e0/(1e0+exp(-{z})))"


def logit_sql(weights=None, intercept=None) -> str:
    return sigmoid_sql(linear_sql(weights, intercept))


def net_sql(layers, features, unit=0, sigmoid=True) -> str:
    """One output of a fixed ReLU net as a scalar expression."""
    values = list(features)
    for k, (matrix, bias) in enumerate(layers):
        last = k == len(layers) - 1
        rows = [
            "(" + " + ".join(f"{_number(w)}*{v}" for w, v in zip(row, values)) + f" + {_number(b)})"
            for row, b in zip(matrix, bias)
        ]
        values = rows if last else [f"greatest({r}, 0e0)" for r in rows]
    return sigmoid_sql(values[unit]) if sigmoid else values[unit]


REWARD = net_sql(I.REWARD_LAYERS, I.FEATURES)
DEEP = net_sql(I.DEEP_POLICY_LAYERS, I.FEATURES)
CRITIC = net_sql(I.CRITIC_LAYERS, I.USER_FEATURES + I.OFFER_FEATURES)
PROTO = [net_sql(I.ACTOR_LAYERS, I.USER_FEATURES, k, sigmoid=False) for k in range(3)]
PROTO_DOT = "(" + " + ".join(f"{p}*{f}" for p, f in zip(PROTO, I.OFFER_FEATURES)) + ")"


def uniform_sql(seed, *parts) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(parts)})), 1, 8))::bigint / 4294967296e0)"


def normal_sql(seed, *parts) -> str:
    def opened(s):
        return f"((('0x' || substr(md5(concat_ws(':', '{s}', {', '.join(parts)})), 1, 8))::bigint + 1e0) / 4294967297e0)"

    return f"(sqrt(-2e0*ln({opened(f'{seed}a')})) * cos(6.283185307179586::double*{opened(f'{seed}b')}))"


def rnd(expression: str, digits: int, name: str) -> str:
    return f"round({expression}, {digits}) + 0e0 as {name}"


def facts(select: str) -> str:
    return f"with {_INTER} {select}"


def dims(select: str, *ctes: str) -> str:
    return ",\n".join([f"with {_INTER}", _DIMS, *ctes]) + "\n" + select


# every user beside every offer with the simulated probability
_PAIRS = f"""pairs as (
 select u.user_key, o.offer_key, {', '.join(I.FEATURES)}, {REWARD} as reward_prob from users u cross join offers o),
optima as (select user_key, max(reward_prob) as optimum from pairs group by user_key)"""


def choice_ctes(score: str, value: str | None = None) -> str:
    """Best offer per user by ``score``; ``value`` is the prediction kept with it."""
    return f"""{_PAIRS},
scored as (select *, {score} as score, {value or score} as pred from pairs),
best as (select * from (select *, row_number() over (partition by user_key order by score desc, offer_key) as rk from scored) where rk = 1)"""


LINK = {"logit": logit_sql(), "linear": linear_sql(), "deep": DEEP, "proto": PROTO_DOT}


def thompson_ctes(std: str, intercept: bool = True) -> str:
    """Best offer per user with drawn weights, as a long sum over the features."""
    rows = [("intercept", I.POLICY_INTERCEPT)] + list(I.POLICY_WEIGHTS.items())
    values = ", ".join(f"('{f}', {_number(m)}, {_number(I.POLICY_PRECISIONS[f])})" for f, m in rows)
    z = " + ".join(
        [f"(select w from drawn where feature = '{f}')*{f}" for f in I.POLICY_WEIGHTS]
        + (["(select w from drawn where feature = 'intercept')"] if intercept else [])
    )
    return f"""weights(feature, m, q) as (values {values}),
drawn as (select feature, m + (1e0/{std}) * {normal_sql(7, 'feature')} as w from weights),
{choice_ctes(sigmoid_sql('(' + z + ')'))}"""


def metric_ctes(model: str, epsilon: float = 0.0, epochs: int = 1, choices: str | None = None, pulled: bool = False) -> str:
    """Per event: pulled offer, reward, loss and the three regrets."""
    explored = "cast(null as bigint)"
    if epsilon:
        keep = uniform_sql("7explore", "epoch", "seq")
        arm = uniform_sql("7arm", "epoch", "seq")
        explored = (
            f"case when {keep} > {_number(epsilon)} then null "
            f"else cast(floor({arm} * (select count(*) from offers)) as bigint) end"
        )
    if choices is None:
        choices = choice_ctes(LINK[model], CRITIC if model == "proto" else None)
    pred = "pulled.pred_pulled" if model == "proto" or pulled else "b.pred"
    value = LINK[model] if pulled else CRITIC
    return f"""{choices},
events_e as (select seq, user_key, (seq - 1)//128 as batch, epoch from replay, (select unnest(range({epochs})) as epoch)),
ex as (select *, {explored} as explored from events_e),
per_event as (
 select ex.epoch, ex.batch, ex.seq, ex.user_key, pulled.offer_key,
  cast(pulled.reward_prob >= 0.5e0 as int)::double as r, pulled.reward_prob as r_prob, o.optimum, {pred} as pred, {', '.join('pulled.' + f for f in I.FEATURES)}
 from ex join best b on ex.user_key = b.user_key join optima o on o.user_key = ex.user_key
 join (select *, {value} as pred_pulled from pairs) pulled
  on pulled.user_key = ex.user_key and pulled.offer_key = coalesce(ex.explored, b.offer_key)),
batches as (
 select epoch, batch, count(*) as n_events,
  count(*) filter (not coalesce(abs(r_prob) + abs(pred) + abs(optimum) < 'infinity'::double, false)) as n_unscored,
  sum(r) as reward, sum(abs(r - pred)) as loss,
  sum(greatest(optimum - r_prob, 0e0)) as regret, sum(abs(optimum - r_prob)) as regret_abs,
  sum(greatest(cast(optimum >= 0.5e0 as int)::double - r, 0e0)) as regret_binary
 from per_event group by epoch, batch having count(*) = 128)"""


def metrics_sql(model, epsilon=0.0, choices=None, pulled=False) -> str:
    return dims(
        f"select batch, n_events, n_unscored, {rnd('reward', 6, 'reward')}, {rnd('loss', 6, 'loss')}, {rnd('regret', 6, 'regret')} from batches",
        metric_ctes(model, epsilon, choices=choices, pulled=pulled),
    )


def one_metric_sql(column, epsilon=0.0) -> str:
    return dims(f"select batch, {rnd(column, 6, column)} from batches", metric_ctes("logit", epsilon))


def log_sql(name, epsilon) -> str:
    """Metric log of four epochs with its iteration number; a full WITH query."""
    return dims(
        f"select '{name}' as policy, epoch, batch, row_number() over (order by epoch, batch) as iteration, "
        "reward, loss, regret from batches",
        metric_ctes("logit", epsilon, 4),
    )


def choice_sql(score, ctes=None) -> str:
    return dims(
        f"select user_key, offer_key as best_offer, {rnd('pred', 9, 'best_score')} from best", ctes or choice_ctes(score)
    )


def gradient_sql(link: str) -> str:
    p = logit_sql() if link == "logit" else linear_sql()
    slope = f"*{p}*(1e0-{p})" if link == "logit" else ""
    factor = f"2e0*({p} - r){slope}"
    rows = [("intercept", I.POLICY_INTERCEPT, "1e0")] + [(f, w, f) for f, w in I.POLICY_WEIGHTS.items()]
    grads = " union all ".join(
        f"select '{f}' as feature, {_number(w)} as w, avg({factor}*{x}) as gradient from per_event" for f, w, x in rows
    )
    return dims(
        f"""select feature, {rnd('gradient', 8, 'gradient')},
 {rnd('w - 1e-4*(gradient + 1e-5*w)/(abs(gradient + 1e-5*w) + 1e-8)', 8, 'w_new')} from grads""",
        metric_ctes(link),
        f"grads as ({grads})",
    )


def precision_sql() -> str:
    p = logit_sql()
    rows = [("intercept", "1e0")] + [(f, f) for f in I.POLICY_WEIGHTS]
    parts = " union all ".join(
        f"select '{f}' as feature, {rnd(f'{_number(I.POLICY_PRECISIONS[f])} + sum({x}*{x}*{p}*(1e0-{p}))', 6, 'q_new')} from per_event"
        for f, x in rows
    )
    return dims(f"select * from ({parts})", metric_ctes("logit"))


def objective_sql() -> str:
    moved = {f: w + 0.1 for f, w in I.POLICY_WEIGHTS.items()}
    p = logit_sql(moved, I.POLICY_INTERCEPT + 0.1)
    prior = " + ".join(
        f"0.5e0*{_number(I.POLICY_PRECISIONS[f])}*({_number(w + 0.1)} - {_number(w)})*({_number(w + 0.1)} - {_number(w)})"
        for f, w in [("intercept", I.POLICY_INTERCEPT), *I.POLICY_WEIGHTS.items()]
    )
    return dims(
        f"""select {rnd('d', 5, 'data_term')}, {rnd(prior, 5, 'prior_term')}, {rnd(f'd + {prior}', 5, 'objective')}
 from (select sum(-(r*ln({p}) + (1e0-r)*ln(1e0-{p}))) as d from per_event)""",
        metric_ctes("logit"),
    )


def lift_ctes(prob: str, bins: int, name: str, source: str = "scored_rows") -> str:
    return f"""{name} as (
 select bin, count(*) as n, cast(sum(target) as bigint) as positives, min({prob}) as min_prob, max({prob}) as max_prob,
  sum(target)/count(*) as rate, (sum(target)/count(*)) / (select sum(target)/count(*) from {source}) as lift
 from (select *, ntile({bins}) over (order by {prob} desc, event_id) as bin from {source}) group by bin)"""


def compare_lift_sql(source: str, bins: int = 20) -> str:
    ctes = ",\n".join(
        [source, lift_ctes("prob_side", bins, "side_bins"), lift_ctes("prob_base", bins, "base_bins")]
    )
    return facts(
        f""", {ctes} select s.bin, s.n as n_with_side, s.positives as positives_with_side, {rnd('s.rate', 9, 'rate_with_side')},
 {rnd('s.lift', 9, 'lift_with_side')}, b.n as n_base, b.positives as positives_base, {rnd('b.rate', 9, 'rate_base')},
 {rnd('b.lift', 9, 'lift_base')} from side_bins s join base_bins b on s.bin = b.bin"""
    )


def rounds_sql(link: str, rounds: int = 4, epochs: int = 4, epsilon: float = 0.0, compat: bool = False, versions: bool = False) -> str:
    """Online rounds as a chain: events of a batch, scores with the weights so far, the next weights.

    Gives the metrics per round, or with ``versions`` the weights before and after every round.
    """
    names = ["intercept", *I.POLICY_WEIGHTS]
    first = {"intercept": I.POLICY_INTERCEPT, **I.POLICY_WEIGHTS}
    ctes = [
        _PAIRS,
        f"sized as (select (count(*) + {rounds - 1})//{rounds} as size from replay)",
        "m0 as (select " + ", ".join(f"{_number(first[f])} as w_{f}" for f in names) + ")",
    ]
    outputs = []
    step = 0
    for epoch in range(epochs):
        for batch in range(rounds):
            def z(t):
                return f"({' + '.join(f'm.w_{f}*{t}.{f}' for f in I.POLICY_WEIGHTS)} + m.w_intercept)"

            def score(t):
                return sigmoid_sql(z(t)) if link == "logit" else z(t)

            explored = "cast(null as bigint)"
            if epsilon:
                keep, arm = uniform_sql("7explore", str(epoch), "seq"), uniform_sql("7arm", str(epoch), "seq")
                explored = (
                    f"case when {keep} > {_number(epsilon)} then null "
                    f"else cast(floor({arm} * (select count(*) from offers)) as bigint) end"
                )
            s = step
            ctes.append(
                f"""b{s} as materialized (select * from (select p.*, {score('p')} as pred,
 row_number() over (partition by p.user_key order by {score('p')} desc, p.offer_key) as rk from pairs p, m{s} m) where rk = 1)"""
            )
            trained = "b" if compat else "p"
            pred = "b.pred" if compat else score("p")
            ctes.append(
                f"""e{s} as materialized (select cast(p.reward_prob >= 0.5e0 as int)::double as r, p.reward_prob as r_prob,
 o.optimum, {pred} as pred, {score(trained)} as p_train, {', '.join(f'{trained}.{f} as {f}' for f in I.POLICY_WEIGHTS)}, 1e0 as intercept
 from (select seq, user_key, {explored} as explored from replay, sized where (seq - 1)//size = {batch}) x
 join b{s} b on b.user_key = x.user_key join optima o on o.user_key = x.user_key
 join pairs p on p.user_key = x.user_key and p.offer_key = coalesce(x.explored, b.offer_key), m{s} m)"""
            )
            slope = "*p_train*(1e0-p_train)" if link == "logit" else ""
            grads = ", ".join(f"avg(2e0*(p_train - r){slope}*{f}) as g_{f}" for f in names)
            ctes.append(f"g{s} as materialized (select {grads} from e{s})")
            moved = ", ".join(
                f"w_{f} - 1e-4*(g_{f} + 1e-5*w_{f})/(abs(g_{f} + 1e-5*w_{f}) + 1e-8) as w_{f}" for f in names
            )
            ctes.append(f"m{s + 1} as materialized (select {moved} from m{s}, g{s})")
            outputs.append(
                f"""select {epoch} as epoch, {batch} as batch, (select count(*) from e{s}) as n_events,
 (select {rnd('sum(r)', 6, 'v')} from e{s}) as reward, (select {rnd('sum(abs(r - pred))', 6, 'v')} from e{s}) as loss,
 (select {rnd('sum(greatest(optimum - r_prob, 0e0))', 6, 'v')} from e{s}) as regret,
 {', '.join(rnd(f'w_{f}', 6, f'w_{f}') for f in names)} from m{s + 1}"""
            )
            step += 1
    if versions:
        outputs = [
            f"select {k} as version, '{f}' as feature, {rnd(f'w_{f}', 8, 'w')} from m{k}" for k in range(step + 1) for f in names
        ]
    return dims(" union all ".join(outputs), *ctes)


def learning_ctes(policies: dict, rounds: int = 4, epochs: int = 4) -> list:
    """CTE log(policy, epoch, batch, iteration, n_events, n_unscored, reward, loss, regret): every policy replayed alone.

    ``policies`` maps names to (link, epsilon).
    """
    names = ["intercept", *I.POLICY_WEIGHTS]
    first = {"intercept": I.POLICY_INTERCEPT, **I.POLICY_WEIGHTS}
    ctes, outputs = [_PAIRS, f"sized as (select (count(*) + {128 * rounds - 1})//{128 * rounds} as per_round from replay)"], []
    for k, (name, (link, epsilon)) in enumerate(policies.items()):
        ctes.append(f"m{k}_0 as (select " + ", ".join(f"{_number(first[f])} as w_{f}" for f in names) + ")")
        z = "(" + " + ".join(f"m.w_{f}*p.{f}" for f in I.POLICY_WEIGHTS) + " + m.w_intercept)"
        score = sigmoid_sql(z) if link == "logit" else z
        for s in range(rounds * epochs):
            epoch, number = divmod(s, rounds)
            explored = "cast(null as bigint)"
            if epsilon:
                keep, arm = uniform_sql("7explore", str(epoch), "seq"), uniform_sql("7arm", str(epoch), "seq")
                explored = f"case when {keep} > {_number(epsilon)} then null else cast(floor({arm} * (select count(*) from offers)) as bigint) end"
            slope = "*p_train*(1e0-p_train)" if link == "logit" else ""
            grads = ", ".join(f"avg(2e0*(p_train - r){slope}*{f}) as g_{f}" for f in names)
            moved = ", ".join(f"w_{f} - 1e-4*(g_{f} + 1e-5*w_{f})/(abs(g_{f} + 1e-5*w_{f}) + 1e-8) as w_{f}" for f in names)
            t = f"{k}_{s}"
            ctes += [
                f"""b{t} as materialized (select * from (select p.*, {score} as pred,
 row_number() over (partition by p.user_key order by {score} desc, p.offer_key) as rk from pairs p, m{t} m) where rk = 1)""",
                f"""e{t} as materialized (select x.batch, cast(p.reward_prob >= 0.5e0 as int)::double as r, p.reward_prob as r_prob,
 o.optimum, b.pred, {score} as p_train, {', '.join(f'p.{f} as {f}' for f in I.POLICY_WEIGHTS)}, 1e0 as intercept
 from (select (seq - 1)//128 as batch, user_key, {explored} as explored from replay, sized where ((seq - 1)//128)//per_round = {number}) x
 join b{t} b on b.user_key = x.user_key join optima o on o.user_key = x.user_key
 join pairs p on p.user_key = x.user_key and p.offer_key = coalesce(x.explored, b.offer_key), m{t} m)""",
                f"g{t} as materialized (select {grads} from e{t})",
                f"m{k}_{s + 1} as materialized (select {moved} from m{t}, g{t})",
            ]
            outputs.append(
                f"""select '{name}' as policy, {epoch} as epoch, batch, count(*) as n_events, 0::bigint as n_unscored, sum(r) as reward,
 sum(abs(r - pred)) as loss, sum(greatest(optimum - r_prob, 0e0)) as regret from e{t} group by batch having count(*) = 128"""
            )
    ctes.append("rounds_log as (" + " union all ".join(outputs) + ")")
    ctes.append("log as (select *, row_number() over (partition by policy order by epoch, batch) as iteration from rounds_log)")
    return ctes


def deep_rounds_sql(rounds: int = 2, epochs: int = 4, epsilon: float = 0.0) -> str:
    """Online rounds of the net policy: forward pass, gradients by the chain rule, sign steps."""
    (w1, b1), (w2, b2), (w3, b3) = I.DEEP_POLICY_LAYERS
    start = {f"a{k}_{i}": v for k, row in enumerate(w1) for i, v in enumerate(row)}
    start |= {f"ab{k}": v for k, v in enumerate(b1)}
    start |= {f"b{j}_{k}": v for j, row in enumerate(w2) for k, v in enumerate(row)}
    start |= {f"bb{j}": v for j, v in enumerate(b2)}
    start |= {f"c{j}": v for j, v in enumerate(w3[0])} | {"cb": b3[0]}
    units, outs = range(len(b1)), range(len(b2))
    first = ", ".join(
        "(" + " + ".join(f"m.a{k}_{i}*x.{f}" for i, f in enumerate(I.FEATURES)) + f" + m.ab{k}) as y{k}" for k in units
    )
    second = ", ".join(
        "(" + " + ".join(f"m.b{j}_{k}*greatest(y{k}, 0e0)" for k in units) + f" + m.bb{j}) as z{j}" for j in outs
    )
    score = sigmoid_sql("(" + " + ".join(f"m.c{j}*greatest(z{j}, 0e0)" for j in outs) + " + m.cb)")
    # derivative of the squared error at the output and before each ReLU
    d = "(2e0*(pred - r)*pred*(1e0-pred))"
    d2 = [f"({d}*m.c{j}*(z{j} > 0)::int)" for j in outs]
    d1 = ["((" + " + ".join(f"{d2[j]}*m.b{j}_{k}" for j in outs) + f")*(y{k} > 0)::int)" for k in units]
    grads = {f"a{k}_{i}": f"{d1[k]}*{f}" for k in units for i, f in enumerate(I.FEATURES)}
    grads |= {f"ab{k}": d1[k] for k in units}
    grads |= {f"b{j}_{k}": f"{d2[j]}*greatest(y{k}, 0e0)" for j in outs for k in units}
    grads |= {f"bb{j}": d2[j] for j in outs} | {f"c{j}": f"{d}*greatest(z{j}, 0e0)" for j in outs} | {"cb": d}
    ctes = [
        _PAIRS,
        f"sized as (select (count(*) + {rounds - 1})//{rounds} as size from replay)",
        "m0 as (select " + ", ".join(f"{_number(v)} as {n}" for n, v in start.items()) + ")",
    ]
    outputs = []
    for s in range(rounds * epochs):
        epoch, batch = divmod(s, rounds)
        explored = "cast(null as bigint)"
        if epsilon:
            keep, arm = uniform_sql("7explore", str(epoch), "seq"), uniform_sql("7arm", str(epoch), "seq")
            explored = (
                f"case when {keep} > {_number(epsilon)} then null "
                f"else cast(floor({arm} * (select count(*) from offers)) as bigint) end"
            )
        ctes += [
            f"y{s} as (select x.*, {first} from pairs x, m{s} m)",
            f"z{s} as (select x.*, {second} from y{s} x, m{s} m)",
            f"p{s} as materialized (select x.*, {score} as pred from z{s} x, m{s} m)",
            f"""b{s} as materialized (select * from (select *,
 row_number() over (partition by user_key order by pred desc, offer_key) as rk from p{s}) where rk = 1)""",
            f"""e{s} as materialized (select x.*, cast(x.reward_prob >= 0.5e0 as int)::double as r, o.optimum
 from (select seq, user_key, {explored} as explored from replay, sized where (seq - 1)//size = {batch}) q
 join b{s} b on b.user_key = q.user_key join optima o on o.user_key = q.user_key
 join p{s} x on x.user_key = q.user_key and x.offer_key = coalesce(q.explored, b.offer_key))""",
            f"g{s} as materialized (select " + ", ".join(f"avg({g}) as g_{n}" for n, g in grads.items()) + f" from e{s} x, m{s} m)",
            f"m{s + 1} as materialized (select "
            + ", ".join(f"{n} - 1e-4*(g_{n} + 1e-5*{n})/(abs(g_{n} + 1e-5*{n}) + 1e-8) as {n}" for n in start)
            + f" from m{s}, g{s})",
        ]
        outputs.append(
            f"""select {epoch} as epoch, {batch} as batch, count(*) as n_events, {rnd('sum(r)', 6, 'reward')},
 {rnd('sum(abs(r - pred))', 6, 'loss')}, {rnd('sum(greatest(optimum - reward_prob, 0e0))', 6, 'regret')} from e{s}"""
        )
    return dims(" union all ".join(outputs), *ctes)


def thompson_rounds_sql(rounds: int = 3, steps: int = 10, seed: int = 7) -> str:
    """Thompson rounds as a chain of weights, like ``rounds_sql``."""
    names = ["intercept", *I.POLICY_WEIGHTS]
    ctes = [
        _PAIRS,
        f"sized as (select (count(*) + {rounds - 1})//{rounds} as size from replay)",
        "post0 as (select " + ", ".join(f"0e0 as m_{f}, 1e0 as q_{f}" for f in names) + ")",
    ]
    outputs = []

    def score(alias):
        return sigmoid_sql(f"({' + '.join(f'{alias}.w_{f}*x.{f}' for f in I.POLICY_WEIGHTS)} + {alias}.w_intercept)")

    for k in range(rounds):
        draws = ", ".join(
            "m_{f} + (1e0/sqrt(q_{f}))*{n} as w_{f}".format(f=f, n=normal_sql(f"{seed}r{k}", "'" + f + "'")) for f in names
        )
        ctes.append(f"d{k} as materialized (select {draws} from post{k})")
        ctes.append(
            f"""b{k} as materialized (select * from (select x.*, {score('d')} as pred,
 row_number() over (partition by x.user_key order by {score('d')} desc, x.offer_key) as rk from pairs x, d{k} d) where rk = 1)"""
        )
        ctes.append(
            f"""e{k} as materialized (select b.*, cast(b.reward_prob >= 0.5e0 as int)::double as r, o.optimum, 1e0 as intercept
 from replay y join b{k} b on b.user_key = y.user_key join optima o on o.user_key = y.user_key, sized where (y.seq - 1)//size = {k})"""
        )
        ctes.append(f"f{k}_0 as (select " + ", ".join(f"m_{f} as w_{f}" for f in names) + f" from post{k})")
        for s in range(steps):
            sums = ", ".join(
                f"sum(({score('w')} - x.r)*x.{f}) as l_{f}, sum(x.{f}*x.{f}*{score('w')}*(1e0-{score('w')})) as p_{f}" for f in names
            )
            ctes.append(f"s{k}_{s} as materialized (select {sums} from e{k} x, f{k}_{s} w)")
            moved = ", ".join(
                f"w_{f} - (q_{f}*(w_{f} - m_{f}) + l_{f})/({len(names)}*(q_{f} + p_{f})) as w_{f}" for f in names
            )
            ctes.append(f"f{k}_{s + 1} as materialized (select {moved} from f{k}_{s}, s{k}_{s}, post{k})")
        last = f"f{k}_{steps}"
        added = ", ".join(f"sum(x.{f}*x.{f}*{score('w')}*(1e0-{score('w')})) as p_{f}" for f in names)
        ctes.append(f"a{k} as materialized (select {added} from e{k} x, {last} w)")
        ctes.append(
            f"post{k + 1} as materialized (select "
            + ", ".join(f"w_{f} as m_{f}, q_{f} + p_{f} as q_{f}" for f in names)
            + f" from {last}, post{k}, a{k})"
        )
        for f in names:
            outputs.append(
                f"""select {k} as batch, '{f}' as feature, {rnd(f'm_{f}', 6, 'm')}, {rnd(f'q_{f}', 6, 'q')},
 (select count(*) from e{k}) as n_events, (select {rnd('sum(r)', 6, 'v')} from e{k}) as reward,
 (select {rnd('sum(abs(r - pred))', 6, 'v')} from e{k}) as loss,
 (select {rnd('sum(greatest(optimum - reward_prob, 0e0))', 6, 'v')} from e{k}) as regret from post{k + 1}"""
            )
    return dims(" union all ".join(outputs), *ctes)


def profile_sql() -> str:
    columns = ["event_id", *I.OFFER_COLUMNS, *I.USER_COLUMNS, "target"]
    return facts(
        " union all ".join(
            f"""select '{c}' as column_name, count(*) as n_rows, count(*) - count({c}) as n_null,
 count(distinct {c}) as n_distinct, min({c})::double as min_value, max({c})::double as max_value from inter"""
            for c in columns
        )
    )


_LAYOUT_TIME = "strftime(redeem_date, '%Y-%m-%d %H:%M:%S') as redeem_date"
_FEATURES = ", ".join(I.FEATURES)
_SEEDS = ", ".join(I.SEED_COLUMNS)
_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
_SPLIT = f"case when {uniform_sql(100, 'event_id')} < 0.1e0 then 'holdout' else 'train' end"
_SCORED = f"scored_rows as (select event_id, round({logit_sql()}, 9) as prob, target from inter)"
_TWO_SCORES = (
    f"scored_rows as (select event_id, round({logit_sql()}, 9) as prob_base, round({REWARD}, 9) as prob_side, target from inter)"
)
_SIDE = f"""side as (select user_id, offer_id, redeem_date, value/1e2 as s_value from inter where event_type = 'purchase'),
scored_rows as (
 select i.event_id, i.target, {logit_sql()} as prob_base,
  {logit_sql({**I.POLICY_WEIGHTS, 's_value': I.SIDE_WEIGHT}).replace('*s_value', '*coalesce(s.s_value, 0e0)')} as prob_side
 from side s right join inter i on s.user_id = i.user_id and s.offer_id = i.offer_id and s.redeem_date = i.redeem_date)"""
_CENTROIDS = """cells as (
 select vec_id, label, unnest(range(64)) as pos, unnest(embedding)::double as v from embeddings),
centroids as (select label, pos, avg(v) as c from cells group by label, pos)"""


def wide_net_sql(widths) -> str:
    """The rule-made net as one grouped sum per layer."""
    ctes = ["h0 as (select vec_id, unnest(range(64)) as pos, unnest(embedding)::double as h from embeddings)"]
    for depth, (n_in, n_out) in enumerate(zip(widths, widths[1:])):
        weight = f"sin(1e0 + 1e3*{depth} + 37e0*u + 11e0*pos)/sqrt({n_in}e0)"
        z = f"sum(h*{weight}) + cos(u + {depth}e0)"
        last = depth == len(widths) - 2
        ctes.append(
            f"""h{depth + 1} as (select vec_id, u as pos, {z if last else f'greatest({z}, 0e0)'} as h
 from h{depth}, (select unnest(range({n_out})) as u) group by vec_id, u)"""
        )
    return f"with {', '.join(ctes)} select vec_id, {rnd(sigmoid_sql('h'), 6, 'score')} from h{len(widths) - 1}"


def fitted_sql(name: str, select: str) -> str:
    """A query over split_rows, models and last, the fitted weights."""
    rows = f"split_rows as (select event_id, {_SPLIT} as split, target::double as y, {_FEATURES} from inter)"
    fit = fit_ctes(I.fit_net(name), **I.FIT)
    steps = I.FIT["epochs"] * I.FIT["batches"]
    return f"with recursive {_INTER}, {rows}, {fit}, last as (select * from models where step = {steps}) {select}"


def errors_sql(name: str) -> str:
    p = net_score_sql(I.fit_net(name))
    batches = I.FIT["batches"]
    return fitted_sql(
        name,
        f"""select step // {batches} as epoch, split, count(*) as n, {rnd(f'avg(({p} - y)*({p} - y))', 6, 'mse')}
 from split_rows, models where step > 0 and step % {batches} = 0 group by 1, 2""",
    )


def _elements(columns):
    return ", ".join(f"{c} as x{i}" for i, c in enumerate(columns))


def oracle_sql() -> dict:
    curve = ", ".join(
        rnd(f"avg({m}) over w", 6, f"avg_{m}") for m in ("reward", "loss", "regret")
    )
    learners = {"greedy": ("logit", 0.0), "egreedy": ("logit", 0.1), "linear": ("linear", 0.0), "linear_egreedy": ("linear", 0.1)}
    learnt = learning_ctes(learners)
    compare = " union all ".join(
        f"select '{m}' as metric, "
        + ", ".join(
            f"""{rnd(f"sum({m}) filter (policy = '{p}')", 6, f'{p}_total')}, {rnd(f"avg({m}) filter (policy = '{p}')", 6, f'{p}_mean')}"""
            for p in learners
        )
        + " from log"
        for m in ("reward", "loss", "regret")
    )
    sql = {
        "scan_csv_roundtrip": facts(f"select user_id, offer_id, {_LAYOUT_TIME}, {_FEATURES}, {_SEEDS}, target from inter"),
        "scan_parquet": "select event_id, user_id, value from events where value >= 50",
        "scan_prefix_files": " union all ".join(f"select '{t}.parquet' as file_name, count(*) as n_rows from {t}" for t in _TABLES),
        "sample_scan": f"select event_id, user_id from events where {uniform_sql(100, 'event_id')} < 0.01e0",
        "metrics_log_roundtrip": dims(
            f"select 'greedy' as policy, batch, {rnd('reward', 6, 'reward')}, {rnd('loss', 6, 'loss')}, {rnd('regret', 6, 'regret')} from batches",
            metric_ctes("logit"),
        ),
        "weights_roundtrip": fitted_sql("reward", f"select event_id, {rnd(net_score_sql(I.fit_net('reward')), 6, 'prob')} from split_rows, last"),
        "project_columns": facts(f"select event_id, offer_id, {', '.join(I.OFFER_FEATURES)}, user_id, {', '.join(I.USER_FEATURES)} from inter"),
        "drop_columns": facts(f"select user_id, offer_id, {_LAYOUT_TIME}, {_FEATURES}, target from inter"),
        "feature_slice": facts(f"select {_FEATURES}, {_SEEDS}, target as label from inter"),
        "assemble_vector": facts(f"select event_id, {_elements(I.FEATURES)} from inter"),
        "context_concat": facts(f"select event_id, {_elements(I.FEATURES)} from inter"),
        "context_intercept": facts(f"select event_id, {_elements(['1e0', *I.FEATURES])} from inter"),
        "reward_threshold": facts(
            f"select event_id, {rnd(REWARD, 9, 'prob')}, cast({REWARD} >= 0.5e0 as int)::double as r from inter"
        ),
        "replay_prefix": dims("select seq, user_key, offer_key from replay"),
        "prob_target_pairs": facts(f"select event_id, {rnd(logit_sql(), 9, 'prob')}, target from inter"),
        "table_profile": profile_sql(),
        "dim_users": facts("select distinct user_id, u_bal, u_bld, u_nat from inter"),
        "dim_offers": facts("select distinct offer_id, o_size, o_price, o_promo from inter"),
        "dim_ids": facts("select distinct user_id from inter"),
        "surrogate_key": dims(
            "select 'user' as kind, user_id as id, user_key as key from users union all select 'offer', offer_id, offer_key from offers"
        ),
        "join_multikey_nullsafe": dims("select event_id, user_key from replay"),
        "join_fact_to_dims": dims("select event_id, user_key, offer_key from replay"),
        "join_single_key": facts(
            """select i.event_id, i.user_id, i.offer_id, u.user_key, o.offer_key from inter i
 join (select user_id, row_number() over (order by min(event_id)) - 1 as user_key from inter group by user_id) u on i.user_id = u.user_id
 join (select offer_id, row_number() over (order by min(event_id)) - 1 as offer_key from inter group by offer_id) o on i.offer_id = o.offer_id"""
        ),
        "right_join_fill_zero": """select d.doc_id, coalesce(l.quality, 0) as quality, coalesce(l.toxic, 0) as toxic, d.lang, d.source,
 coalesce(d.n_chars, 0) as n_chars from labels l right join documents d on l.doc_id = d.doc_id""",
        "context_cross_join": dims(
            f"select user_key, offer_key, {_FEATURES} from users cross join offers"
        ),
        "embedding_lookup": dims(
            f"select r.seq, r.user_key, r.offer_key, {_FEATURES} from replay r join users u on u.user_key = r.user_key join offers o on o.offer_key = r.offer_key"
        ),
        "epoch_replay": dims(
            f"select epoch, batch, n_events, n_unscored, {rnd('reward', 6, 'reward')}, {rnd('loss', 6, 'loss')}, {rnd('regret', 6, 'regret')} from batches",
            metric_ctes("logit", 0.1, 4),
        ),
        "batch_assign": dims("select seq, (seq - 1)//128 as batch, (seq - 1) % 128 as place from replay"),
        "batch_reward": one_metric_sql("reward"),
        "batch_loss": one_metric_sql("loss"),
        "batch_regret": one_metric_sql("regret"),
        "regret_abs": one_metric_sql("regret_abs"),
        "regret_binary": one_metric_sql("regret_binary", 0.1),
        "optimal_reward": dims(f"select user_key, {rnd('optimum', 9, 'optimum')} from optima", _PAIRS),
        "complete_batches": dims("select (seq - 1)//128 as batch, count(*) as n_events from replay group by 1 having count(*) = 128"),
        "dim_counts": dims("select (select count(*) from users) as num_users, (select count(*) from offers) as num_offers"),
        "distinct_offer_count": facts("select count(distinct offer_id) as n_offers, count(distinct user_id) as n_users from inter"),
        "mse": facts(
            f"select {_SPLIT} as split, count(*) as n, {rnd(f'avg(({logit_sql()} - target)*({logit_sql()} - target))', 9, 'mse')} from inter group by 1"
        ),
        "policy_gradient_step": gradient_sql("logit"),
        "policy_gradient_step_linear": gradient_sql("linear"),
        "posterior_precision": precision_sql(),
        "posterior_objective": objective_sql(),
        "learning_log": dims(
            f"select policy, epoch, batch, iteration, n_events, n_unscored, {rnd('reward', 6, 'reward')}, {rnd('loss', 6, 'loss')}, {rnd('regret', 6, 'regret')} from log",
            *learnt,
        ),
        "learning_curve": dims(
            f"select policy, iteration, {curve} from log window w as (partition by policy order by iteration rows between 100 preceding and current row)",
            *learnt,
        ),
        "curve_iteration": f"select policy, epoch, batch, iteration from ({log_sql('greedy', 0.0)})",
        "event_sequence": dims("select event_id, seq from replay"),
        "lift_bins": facts(
            f", {_SCORED}, {lift_ctes('prob', 10, 'bins')} select bin, n, positives, {rnd('min_prob', 9, 'min_prob')}, "
            f"{rnd('max_prob', 9, 'max_prob')}, {rnd('rate', 9, 'rate')}, {rnd('lift', 9, 'lift')} from bins"
        ),
        "lift_cumulative": facts(
            f""", {_SCORED}, {lift_ctes('prob', 10, 'bins')},
 running as (select bin, cast(sum(n) over (order by bin) as bigint) as cum_n, cast(sum(positives) over (order by bin) as bigint) as cum_positives from bins)
 select bin, cum_n, cum_positives, {rnd('cum_positives/(select sum(positives) from bins)', 9, 'gain')},
 {rnd('(cum_positives/cum_n)/(select sum(positives)/sum(n) from bins)', 9, 'cum_lift')} from running"""
        ),
        "lift_compare": compare_lift_sql(_TWO_SCORES),
        "sort_by_key": dims("select offer_key, o_size, o_price, o_promo from offers order by offer_key"),
        "head_n": dims("select user_key, user_id, u_bal, u_bld, u_nat from users order by user_key limit 5"),
        "argmax_arm": dims(
            f"select user_key, offer_key, {rnd('pred', 9, 'prob')} from best", choice_ctes("reward_prob")
        ),
        "proto_arm_top1": f"""with {_CENTROIDS},
 dots as (select x.label, y.vec_id, sum(x.c*y.v) as score from centroids x join cells y on x.pos = y.pos group by x.label, y.vec_id)
 select cast(label as bigint) as label, vec_id, {rnd('score', 5, 'score')} from
 (select *, row_number() over (partition by label order by score desc, vec_id) as rk from dots) where rk = 1""",
        "nearest_vector": f"""with dots as (
 select a.vec_id as query_id, b.vec_id, list_dot_product(cast(a.embedding as double[]), cast(b.embedding as double[])) as score
 from embeddings a cross join embeddings b)
 select query_id, vec_id, {rnd('score', 5, 'score')} from
 (select *, row_number() over (partition by query_id order by score desc, vec_id) as rk from dots) where rk = 1""",
        "policy_compare": dims(compare, *learnt),
        "score_linear": facts(f"select event_id, {rnd(linear_sql(), 9, 'score')} from inter"),
        "score_logit": facts(f"select event_id, {rnd(logit_sql(), 9, 'score')} from inter"),
        "score_mlp": facts(f"select event_id, {rnd(REWARD, 9, 'score')} from inter"),
        "score_mlp_batched": facts(f"select event_id, {rnd(REWARD, 9, 'score')} from inter"),
        "score_mlp_wide": wide_net_sql((64, 16, 8, 1)),
        "score_mlp_halving": wide_net_sql((64, 32, 16, 8, 4, 1)),
        "vector_dot": f"""with {_CENTROIDS} select y.vec_id, {rnd('sum(x.c*y.v)', 5, 'dot')}
 from cells y join centroids x on x.label = y.label and x.pos = y.pos group by y.vec_id""",
        "policy_greedy": choice_sql(LINK["logit"]),
        "policy_greedy_linear": choice_sql(LINK["linear"]),
        "policy_greedy_deep": choice_sql(LINK["deep"]),
        "policy_egreedy": dims(
            "select x.seq, coalesce(x.explored, b.offer_key) as offer_key, cast(x.explored is not null as int) as explores from ex x join best b on x.user_key = b.user_key",
            metric_ctes("logit", 0.1),
        ),
        "policy_thompson": choice_sql(None, thompson_ctes("sqrt(q)")),
        "policy_thompson_inverse": choice_sql(None, thompson_ctes("q")),
        "policy_thompson_no_intercept": choice_sql(None, thompson_ctes("sqrt(q)", intercept=False)),
        "policy_proto_arm": dims(
            f"select user_key, offer_key as best_offer, {rnd('score', 9, 'proto_score')}, {rnd('pred', 9, 'value')} from best",
            choice_ctes(PROTO_DOT, CRITIC),
        ),
        "reward_of_choice": dims(
            f"select user_key, offer_key, {rnd('reward_prob', 9, 'prob')}, cast(reward_prob >= 0.5e0 as int)::double as r from best",
            choice_ctes(LINK["logit"]),
        ),
        "policy_rounds": rounds_sql("logit"),
        "policy_rounds_linear": rounds_sql("linear"),
        "policy_rounds_egreedy": rounds_sql("logit", epsilon=0.1),
        "policy_rounds_egreedy_compat": rounds_sql("logit", epsilon=0.1, compat=True),
        "policy_rounds_linear_egreedy": rounds_sql("linear", epsilon=0.1),
        "policy_rounds_deep": deep_rounds_sql(),
        "policy_rounds_deep_egreedy": deep_rounds_sql(epsilon=0.1),
        "thompson_rounds": thompson_rounds_sql(),
        "train_holdout_split": facts(f"select event_id, {_SPLIT} as split from inter"),
        "shuffled_batches": f"with recursive {_INTER}, {places_ctes('inter', 'event_id', 30, 100)} select epoch, event_id, x // 126 as batch from places",
        "reward_model_fit": errors_sql("reward"),
        "reward_model_logit": errors_sql("logit"),
        "score_table": fitted_sql(
            "reward", f"select event_id, {rnd(net_score_sql(I.fit_net('reward')), 6, 'prob')}, y::int as target from split_rows, last where split = 'holdout'"
        ),
        "feature_set_eval": compare_lift_sql(_SIDE),
        "stream_batch_metrics": metrics_sql("logit"),
        "stream_policy_update": rounds_sql("logit", epochs=1, versions=True),
        "policy_metrics": metrics_sql("logit"),
        "policy_metrics_logit_egreedy": metrics_sql("logit", 0.1),
        "policy_metrics_egreedy_pulled_loss": metrics_sql("logit", 0.1, pulled=True),
        "policy_metrics_linear_greedy": metrics_sql("linear"),
        "policy_metrics_linear_egreedy": metrics_sql("linear", 0.1),
        "policy_metrics_deep_greedy": metrics_sql("deep"),
        "policy_metrics_deep_egreedy": metrics_sql("deep", 0.1),
        "policy_metrics_proto_arm": metrics_sql("proto"),
        "policy_metrics_thompson": metrics_sql("logit", choices=thompson_ctes("sqrt(q)")),
    }
    return sql
