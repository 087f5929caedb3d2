"""DuckDB twins of the forest queries: all trees of all training sets grow level by
level over plain tables of cells, splits and members (see ``operators.forest`` for
the rules both sides follow)."""

from __future__ import annotations

import math

from .sources.survey import MODEL_FEATURES, SURVEY_KEY

P = len(MODEL_FEATURES)
UNIT = "1e-6"


def _key_number(salt: str) -> str:
    key = ", ".join(f"cast({c} as varchar)" for c in SURVEY_KEY)
    return f"cast('0x' || substr(md5(concat_ws('|', {salt}, {key})), 1, 15) as bigint)"


def _poisson(u: str) -> str:
    """The number of Poisson(1) bounds, times 2^60, at or below ``u``."""
    total, bounds = 0.0, []
    for k in range(8):
        total += math.exp(-1.0) / math.factorial(k)
        bounds.append(int(total * (1 << 60)))
    return " + ".join(f"cast({u} >= {b} as integer)" for b in bounds)


def grown(trees: int, depth: int, folds: int = 0, fold_hash: str = "", bins: int = 32, seed: int = 42,
          name: str = "f") -> str:
    """CTEs ``{name}_split`` (set_no, tree, node, f, bin, gain), ``{name}_value``
    (set_no, tree, node, value) and ``{name}_tr`` / ``{name}_te`` (rid, bmi, fold, b:
    bins of the features) out of ``tr`` and ``te``."""
    x = ", ".join(f"cast({f} as double)" for f in MODEL_FEATURES)
    probs = "[" + ", ".join(repr(i / bins) for i in range(1, bins)) + "]"
    fold = f"cast({fold_hash} % {folds} as integer)" if folds else "-1"
    weight = (f"list_transform(range({trees}), lambda t: {_key_number(f"'{seed}|tree ' || t")})" if trees > 1 else "[0]")
    drawn = f"list_transform(u, lambda u: {_poisson('u')})" if trees > 1 else "[1]"
    width = P if trees == 1 else -(-P // 3)
    cuts = ", ".join(f"list_distinct(quantile_cont(cast({f} as double), {probs})) as c{i}" for i, f in enumerate(MODEL_FEATURES))
    binned = "[" + ", ".join(f"len(list_filter(c{i}, lambda c: c < x[{i + 1}]))" for i in range(P)) + "]"

    def rows(table: str) -> str:
        return (f"(select row_number() over () as rid, bmi, cast(round(cast(bmi as double) * 1e6) as bigint) as y, {fold} as fold, "
                f"[{x}] as x, {weight} as u from {table})")

    out = [f"{name}_cut as materialized (select {cuts} from tr)"]
    for table in ("tr", "te"):
        out.append(f"{name}_{table} as materialized (select rid, bmi, y, fold, {binned} as b, {drawn} as w "
                   f"from {rows(table)}, {name}_cut)")
    out.append(f"{name}_m0 as materialized (select s.s as set_no, t.t as tree, rid, y, b, w[t.t + 1] as w, 1 as node "
               f"from {name}_tr, (select unnest(range({folds + 1})) as s) s, (select unnest(range({trees})) as t) t "
               f"where w[t.t + 1] > 0 and (fold <> s.s or s.s = {folds}))")
    for level in range(depth):
        open_ = f"node >= {1 << level}"
        out += [
            f"{name}_a{level} as (select * from (select tree, node, f, row_number() over (partition by tree, node order by "
            f"md5(concat_ws('|', '{seed}', tree, node, f))) as place from (select unnest(range({trees})) as tree), "
            f"(select unnest(range({1 << level}, {2 << level})) as node), (select unnest(range({P})) as f)) where place <= {width})",
            f"{name}_c{level} as materialized (select set_no, m.tree, m.node, f, b[f + 1] as bin, cast(sum(w) as hugeint) as w, "
            f"sum(cast(w * y as hugeint)) as wy from {name}_m{level} m join {name}_a{level} a on a.tree = m.tree and a.node = m.node "
            f"where m.{open_} group by all)",
            f"{name}_g{level} as (select *, cast(s - sl as double) as sr, cast(n - nl as double) as nr from (select *, "
            f"sum(w) over up as nl, sum(wy) over up as sl, sum(w) over one as n, sum(wy) over one as s from {name}_c{level} "
            f"window one as (partition by set_no, tree, node, f), up as (partition by set_no, tree, node, f order by bin)))",
            f"{name}_s{level} as materialized (select * from (select *, row_number() over (partition by set_no, tree, node "
            f"order by gain desc nulls last, f, bin) as place from (select *, case when nr > 0 then cast(sl as double) * cast(sl as double) "
            f"/ cast(nl as double) + sr * sr / nr - cast(s as double) * cast(s as double) / cast(n as double) end as gain "
            f"from {name}_g{level})) where place = 1)",
        ]
        if level + 1 < depth:
            out.append(f"{name}_m{level + 1} as materialized (select m.set_no, m.tree, rid, y, b, m.w, 2 * m.node + cast(b[f + 1] > bin as integer) as node "
                       f"from {name}_m{level} m join {name}_s{level} s on s.set_no = m.set_no and s.tree = m.tree and s.node = m.node where gain > 0)")
    every = " union all ".join(f"select set_no, tree, node, f, bin, gain, nl, sl, n, s from {name}_s{k}" for k in range(depth))
    mean = f"cast({{s}} as double) / cast({{n}} as double) * {UNIT}"
    last = f"{name}_s{depth - 1} where gain > 0"
    out += [
        f"{name}_split as materialized ({every})",
        f"{name}_value as materialized (select set_no, tree, node, {mean.format(s='s', n='n')} as value from {name}_split "
        f"union all select set_no, tree, 2 * node, {mean.format(s='sl', n='nl')} from {last} "
        f"union all select set_no, tree, 2 * node + 1, {mean.format(s='(s - sl)', n='(n - nl)')} from {last})",
    ]
    return ", " + ",\n".join(out)


def placed(rows: str, sets: str, trees: int, depth: int, out: str, name: str = "f") -> str:
    """CTE ``out`` (d, set_no, tree, rid, bmi, value): each row's node value in each
    tree cut at each depth d; ``sets`` is the rows' training set."""
    parts = [f"{out}0 as materialized (select {sets} as set_no, t.t as tree, rid, bmi, b, 1 as node from {rows}, "
             f"(select unnest(range({trees})) as t) t)"]
    for k in range(depth):
        parts.append(f"{out}{k + 1} as materialized (select p.set_no, p.tree, rid, bmi, b, case when s.gain > 0 then 2 * p.node + cast(b[s.f + 1] > s.bin as integer) "
                     f"else p.node end as node from {out}{k} p left join {name}_split s on s.set_no = p.set_no and s.tree = p.tree and s.node = p.node)")
    union = " union all ".join(f"select {k} as d, p.set_no, p.tree, rid, bmi, value from {out}{k} p join {name}_value v "
                               f"on v.set_no = p.set_no and v.tree = p.tree and v.node = p.node" for k in range(1, depth + 1))
    return ", " + ",\n".join([*parts, f"{out} as ({union})"])


def rmse(out: str, trees: str, depth: str, extra: str = "") -> str:
    """RMSE of the mean of the first trees at a depth."""
    return (f"(select sqrt(avg(power(bmi - prediction, 2))) as rmse from (select rid, any_value(bmi) as bmi, sum(value) / count(*) as prediction "
            f"from {out}{extra} where tree < {trees} and d = {depth} group by rid))")


def importances(last_set: int, trees: str, depth: str, name: str = "f", extra: str = "") -> str:
    """(f, importance): gains by feature, made one per tree and over all trees."""
    return (f"(select f, total / sum(total) over () as importance from (select x.f, coalesce(sum(share), 0) as total "
            f"from (select unnest(range({P})) as f) x left join (select tree, f, sum(gain) / sum(sum(gain)) over (partition by tree) as share "
            f"from {name}_split{extra} where set_no = {last_set} and gain > 0 and tree < {trees} and node < power(2, {depth}) group by tree, f) g "
            f"on g.f = x.f group by x.f))")


def feature_name(f: str = "f") -> str:
    return "[" + ", ".join(f"'{x}'" for x in MODEL_FEATURES) + f"][{f} + 1]"


def searched(trees: list[int], depths: list[int], folds: int, fold_hash: str) -> str:
    """A grid search: ``log``, ``rk`` (as in the other searches), ``best`` (trees,
    depth) and ``bt``, the test rows placed in the trees grown on all rows."""
    n, d = max(trees), max(depths)
    grid = ", ".join(f"({i}, {t}, {k}, 'maxDepth={k} numTrees={t}')" for i, (t, k) in enumerate((t, k) for t in trees for k in depths))
    return (grown(n, d, folds, fold_hash) + placed("f_tr", "fold", n, d, "va") + placed("f_te", str(folds), n, d, "bt") + f""",
grid(param_id, trees, depth, params) as (values {grid}),
log as (select set_no as fold, param_id, any_value(params) as params, sqrt(avg(power(bmi - prediction, 2))) as metric
        from (select set_no, param_id, any_value(params) as params, rid, any_value(bmi) as bmi, sum(value) / count(*) as prediction
              from va join grid on tree < trees and d = depth group by set_no, param_id, rid) group by set_no, param_id),
rk as (select param_id, params, avg(metric) as avg_metric, stddev_samp(metric) as std_metric,
         arg_max(metric, fold) as last_fold_metric, count(*) as folds,
         cast(row_number() over (order by avg(metric), params) as integer) as rank
       from log group by param_id, params),
best as (select trees, depth from rk join grid using (param_id) where rank = 1)""")
