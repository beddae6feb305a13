"""SQL of shuffled batches and of fits: the permutation and every step of the optimizer as recursive queries."""

from armlight.operators import permutation as P


def _round_function(x: str, key: str) -> str:
    y = f"(({x} * {P.FIRST} + {key}) % {P.MODULUS})"
    y = f"((xor({y}, {y} >> 15) * {P.SECOND}) % {P.MODULUS})"
    return f"xor({y}, {y} >> 13)"


def _once(columns: str, x: str, source: str, seed: int) -> str:
    """One pass through the network: ``source`` has ``x``, ``epoch``, ``half``."""
    inner = f"select {columns}, epoch, half, n, ({x}) >> half as l0, ({x}) & ((1 << half) - 1) as r0 from {source}"
    for r in range(P.ROUNDS):
        key = f"((({seed * 1_000_003} + epoch * 10007 + {r * 101}) % {P.MODULUS} * 1103515245 + 12345) % {P.MODULUS})"
        inner = (
            f"select {columns}, epoch, half, n, r{r} as l{r + 1}, "
            f"xor(l{r}, {_round_function(f'r{r}', key)} & ((1 << half) - 1)) as r{r + 1} from ({inner})"
        )
    last = P.ROUNDS
    return f"select {columns}, epoch, half, n, (l{last} << half) | r{last} as x from ({inner})"


def places_ctes(rows: str, key: str, epochs: int, seed: int) -> str:
    """CTE places(key, epoch, n, x): x is the place of each of the ``rows`` (key) in each epoch's order."""
    # the smallest half for which 4^half covers n
    half = "(select min(h) from range(1, 32) t(h) where (1::bigint << (2 * h)) >= (select count(*) from numbered))"
    return f"""numbered as (select {key}, row_number() over (order by {key}) - 1 as num from {rows}),
starts as (select {key}, num, epoch, {half}::bigint as half, (select count(*) from numbered) as n
 from numbered, (select unnest(range({epochs})) as epoch)),
walks as ({_once(key, 'num', 'starts', seed)} union all {_once(key, 'x', '(select * from walks where x >= n)', seed)}),
places as (select {key}, epoch, n, x from walks where x < n)"""


def fit_ctes(net, epochs: int, batches: int, rate: float, seed: int, decay: float = 1e-5) -> str:
    """CTE models(step, w0, ...): the weights after each step, from rows split_rows(event_id, split, y, features)."""

    def number(v):
        return f"({float(v)!r}::double)"

    flat, layers, at = [], [], 0
    for matrix, bias in net.layers:
        n_out, n_in = len(matrix), len(matrix[0])
        flat += [v for row in matrix for v in row] + list(bias)
        layers.append(([[at + j * n_in + i for i in range(n_in)] for j in range(n_out)], [at + n_out * n_in + j for j in range(n_out)]))
        at += n_out * (n_in + 1)
    k = range(len(flat))
    outs, columns = list(net.features), []
    inputs = []
    for depth, (matrix, bias) in enumerate(layers):
        inputs.append(outs)
        here = []
        for j, row in enumerate(matrix):
            z = " + ".join(f"w{w}*{x}" for w, x in zip(row, outs)) + f" + w{bias[j]}"
            last = depth == len(layers) - 1
            columns.append(f"{f'1e0/(1e0+exp(-({z})))' if last else f'greatest({z}, 0e0)'} as o{depth}_{j}")
            here.append(f"o{depth}_{j}")
        outs = here
    p = outs[0]
    deltas = [f"2e0*({p} - y)*{p}*(1e0-{p})"]
    grads = {}
    for depth in range(len(layers) - 1, -1, -1):
        matrix, bias = layers[depth]
        names = [f"d{depth}_{j}" for j in range(len(matrix))]
        columns += [f"{d} as {n}" for d, n in zip(deltas, names)]
        for row, b, name in zip(matrix, bias, names):
            grads |= {w: f"{name}*{x}" for w, x in zip(row, inputs[depth])} | {b: name}
        deltas = [
            "(" + " + ".join(f"{n}*w{row[i]}" for n, row in zip(names, matrix)) + f")*({inputs[depth][i]} > 0)::int"
            for i in range(len(inputs[depth]))
        ]
    held = ", ".join(f"w{i}, a{i}, b{i}" for i in k)
    means = ", ".join(f"any_value(w{i}) as w{i}, any_value(a{i}) as a{i}, any_value(b{i}) as b{i}, avg({grads[i]}) + {decay!r}*any_value(w{i}) as g{i}" for i in k)
    moved = ", ".join(
        f"w{i} - {rate!r}*((0.9e0*a{i} + 0.1e0*g{i})/(1e0 - pow(0.9e0, step)))/(sqrt((0.999e0*b{i} + 0.001e0*g{i}*g{i})/(1e0 - pow(0.999e0, step))) + 1e-8) as w{i}, "
        f"0.9e0*a{i} + (1e0-0.9e0)*g{i} as a{i}, 0.999e0*b{i} + (1e0-0.999e0)*g{i}*g{i} as b{i}"
        for i in k
    ).replace("0.1e0*g", "(1e0-0.9e0)*g").replace("0.001e0*g", "(1e0-0.999e0)*g")
    start = ", ".join(f"{number(v)} as w{i}, 0e0 as a{i}, 0e0 as b{i}" for i, v in enumerate(flat))
    return f"""{places_ctes("(select event_id from split_rows where split = 'train')", "event_id", epochs, seed)},
batched as materialized (select r.*, p.epoch*{batches} + p.x // ((p.n + {batches - 1})//{batches}) as at_step
 from split_rows r join places p on p.event_id = r.event_id),
models as (
 select 0::bigint as step, {start}
 union all
 select step, {moved} from (
  select m_step + 1 as step, {means} from (
   select m.step as m_step, {held}, y, {', '.join(net.features)}, {', '.join(columns)} from models m join batched t on t.at_step = m.step)
  group by m_step))"""


def net_score_sql(net) -> str:
    """The output of a net whose weights are columns w0, ... of the row."""
    outs, at = list(net.features), 0
    for depth, (matrix, _) in enumerate(net.layers):
        n_out, n_in = len(matrix), len(matrix[0])
        zs = ["(" + " + ".join(f"w{at + j * n_in + i}*{x}" for i, x in enumerate(outs)) + f" + w{at + n_out * n_in + j})" for j in range(n_out)]
        at += n_out * (n_in + 1)
        outs = zs if depth == len(net.layers) - 1 else [f"greatest({z}, 0e0)" for z in zs]
    return f"(1e0/(1e0+exp(-{outs[0]})))"
