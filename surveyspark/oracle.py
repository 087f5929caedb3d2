"""DuckDB twins of the registered queries (same keys as ``catalog.QUERIES``).

Each statement starts from the base tables through the ``survey`` CTE and
is written independently of the Spark code: plain SQL aggregates, window
functions and joins. Doubles are rounded to 6 places and counts cast to
bigint so both sides hash alike.
"""

from __future__ import annotations

from . import oracle_forest as forest
from .sources.survey import CLEAN_COLUMNS, MODEL_FEATURES, SURVEY_KEY, with_survey

# Declared schema of ``survey`` (FIXTURES.md B), in column order.
SURVEY_TYPES = [
    ("case_id", "bigint"), ("l_orderkey", "bigint"), ("l_partkey", "bigint"),
    ("l_suppkey", "bigint"), ("activity_n", "int"), ("bmi", "double"),
    ("prim_min", "double"), ("sec_min", "double"), ("soda", "int"),
    ("exercise", "int"), ("income", "int"), ("exfreq", "int"), ("age", "int"),
    ("loc", "int"), ("earn", "double"), ("sex", "int"),
]

SURVEY_COLS = ", ".join(n for n, _ in SURVEY_TYPES)
ROUNDED_SURVEY_COLS = ", ".join(
    f"round({n}, 6) as {n}" if t == "double" else n for n, t in SURVEY_TYPES)

DESCRIBE_COLUMNS = ["activity_n", "bmi", "prim_min", "sec_min", "soda", "exercise",
                    "income", "exfreq", "age", "loc", "earn", "sex"]

ROUNDED_SURVEY_COLS_E = ", ".join(
    f"round(e.{n}, 6) as {n}" if t == "double" else f"e.{n}" for n, t in SURVEY_TYPES)

CAL = """calendar as (
  select substr(cast(case_id as varchar), 1, 4) as year,
         substr(cast(case_id as varchar), 5, 2) as month, *
  from survey)"""

CLEAN_WHERE = """(bmi is null or bmi <> -1)
  and soda in (1, 2, 3) and exercise in (1, 2) and income in (1, 2, 3)
  and (exfreq is null or exfreq <> -1) and (loc is null or loc <> -1)"""


def _cal(sql: str) -> str:
    return with_survey(f", {CAL}\n{sql}")


def _describe_sql() -> str:
    parts = []
    for i, n in enumerate(DESCRIBE_COLUMNS):
        x = f"cast({n} as double)"
        parts.append(
            f"select {i} as position, '{n}' as column_name, count({x}) as n, "
            f"round(avg({x}), 6) as mean, round(stddev_samp({x}), 6) as std, "
            f"round(min({x}), 6) as min, round(quantile_cont({x}, 0.25), 6) as p25, "
            f"round(quantile_cont({x}, 0.5), 6) as p50, "
            f"round(quantile_cont({x}, 0.75), 6) as p75, round(max({x}), 6) as max "
            f"from survey")
    return with_survey("\nunion all\n".join(parts))


def _csv_sql() -> str:
    """Lines of orders 7 and 13 of every 50 have a wrong number of fields, those of
    21 and 33 a value of a wrong type; a file has 64-bit whole numbers only."""
    parts = [
        f"select '{n}' as \"column\", '{'double' if t == 'double' else 'bigint'}' as type, "
        f"count({n}) as non_null, round(cast(min({n}) as double), 6) as lowest, "
        f"round(cast(max({n}) as double), 6) as highest, count(*) as rows_kept from kept"
        for n, t in SURVEY_TYPES]
    return with_survey(", kept as (select * from survey where l_orderkey % 50 not in (7, 13, 21, 33)),\n"
                       "bad as (select count(*) filter (where l_orderkey % 50 in (7, 13)) as quarantined_fields,\n"
                       "  count(*) filter (where l_orderkey % 50 in (21, 33)) as quarantined_values from survey)\n"
                       "select c.*, bad.* from (" + "\nunion all\n".join(parts) + ") c, bad")


def _profile_sql() -> str:
    parts = [
        f"select {i} as position, '{n}' as column_name, '{t}' as data_type, "
        f"count(*) as rows, count({n}) as non_null, count(*) - count({n}) as null_count "
        f"from survey"
        for i, (n, t) in enumerate(SURVEY_TYPES)]
    return with_survey("\nunion all\n".join(parts))


SENTINEL_SPEC = [("bmi", "-1"), ("soda", "-2"), ("exercise", "-1"), ("income", "-1"),
                 ("exfreq", "-1"), ("sec_min", "-1"), ("earn", "-1")]


def _sentinel_sql() -> str:
    parts = [
        f"select {i} as position, '{c}' as column_name, "
        f"count_if({c} in ({codes})) as sentinel_rows, count({c}) as non_null, "
        f"round(100E0 * count_if({c} in ({codes})) / count({c}), 6) as pct from survey"
        for i, (c, codes) in enumerate(SENTINEL_SPEC)]
    return with_survey("\nunion all\n".join(parts))


def _funnel_sql() -> str:
    rules = [
        ("bmi drop [-1]", "(bmi is null or bmi <> -1)"),
        ("soda keep [1,2,3]", "soda in (1, 2, 3)"),
        ("exercise keep [1,2]", "exercise in (1, 2)"),
        ("income keep [1,2,3]", "income in (1, 2, 3)"),
        ("exfreq drop [-1]", "(exfreq is null or exfreq <> -1)"),
        ("loc drop [-1]", "(loc is null or loc <> -1)"),
    ]
    parts = ["select 0 as step, 'input' as rule, count(*) as rows_left from survey"]
    cond = "true"
    for i, (name, pred) in enumerate(rules):
        cond = f"{cond} and {pred}"
        parts.append(f"select {i + 1}, '{name}', count_if({cond}) from survey")
    return with_survey("\nunion all\n".join(parts))


EDITED = f"edited as (select * from survey where {CLEAN_WHERE})"


def _hash(salt: str) -> str:
    """The first 15 hexadecimal digits of an MD5 of salt and row key."""
    key = ", ".join(f"cast({c} as varchar)" for c in SURVEY_KEY)
    return f"cast('0x' || substr(md5(concat_ws('|', '{salt}', {key})), 1, 15) as bigint)"


SPLIT_HASH, FOLD_HASH, ORDER_HASH = _hash("split"), _hash("fold"), _hash("order")
REFERENCE_LABELS_SQL = "['Very High', 'High', 'Med', 'Low', 'Very Low']"


def _edited(sql: str) -> str:
    return with_survey(f", {EDITED}\n{sql}")


def _bin(x: str, lo: str, hi: str, n: int) -> str:
    return (f"case when {x} is null then null when {hi} = {lo} then {n // 2 + 1} "
            f"else least(cast(floor(({x} - {lo}) * {n} / ({hi} - {lo})) as integer) + 1, {n}) end")


def _box(src: str, groups: list[str], value: str) -> str:
    g = ", ".join(groups)
    notnull = " and ".join(f"{c} is not null" for c in groups + [value])
    lo = "q.q1 - 15E-1 * (q.q3 - q.q1)"
    hi = "q.q3 + 15E-1 * (q.q3 - q.q1)"
    return f""", d as (select {g}, {value} as v from {src} where {notnull}),
q as (select {g}, count(*) as n, avg(v) as mean, quantile_cont(v, 0.25) as q1,
        quantile_cont(v, 0.5) as median, quantile_cont(v, 0.75) as q3,
        min(v) as mn, max(v) as mx
      from d group by {g}),
w as (select q.*, min(case when d.v >= {lo} then d.v end) as wlo,
        max(case when d.v <= {hi} then d.v end) as whi,
        count_if(d.v < {lo} or d.v > {hi}) as nout
      from d join q using ({g})
      group by all)
select {g}, n, round(mean, 6) as mean, round(q1, 6) as q1, round(median, 6) as median,
  round(q3, 6) as q3, round(q3 - q1, 6) as iqr,
  round(case when wlo is null or wlo > q1 then q1 else wlo end, 6) as whislo,
  round(case when whi is null or whi < q3 then q3 else whi end, 6) as whishi,
  cast(nout as bigint) as n_outliers, round(mn, 6) as min, round(mx, 6) as max
from w"""


def _binned_box(value_col: str, extra_where: str) -> str:
    b = _bin(value_col, "lo", "hi", 5)
    return _edited(f""", s as (select * from edited where {extra_where}),
r as (select min(cast({value_col} as double)) as lo, max(cast({value_col} as double)) as hi
      from s where {value_col} is not null),
bs as (select s.*, {b} as bin from s, r),
bl as (select *, {REFERENCE_LABELS_SQL}[bin] as bin_label from bs)"""
                   + _box("bl", ["bin", "bin_label"], "bmi"))


def _corr_sql() -> str:
    cols = list(CLEAN_COLUMNS)
    parts = [f"select '{a}' as col_x, '{b}' as col_y, "
             f"round(corr(cast({a} as double), cast({b} as double)), 6) as corr from edited"
             for i, a in enumerate(cols) for b in cols[i + 1:]]
    return _edited("\nunion all\n".join(parts))


def _split_summary(by: str) -> str:
    return (f"{by}, count(*) as n, cast(sum(l_orderkey) as bigint) as sum_orderkey, "
            "round(avg(bmi), 6) as mean_bmi")


SPLIT = f""", tr as (select * from edited where {SPLIT_HASH} % 100 < 70),
te as (select * from edited where {SPLIT_HASH} % 100 >= 70)"""

# Two-feature least squares (prim_min, age) by the normal equations.
OLS2 = """, st as (select covar_pop(prim_min, prim_min) as v11, covar_pop(age, age) as v22,
        covar_pop(prim_min, age) as v12, covar_pop(prim_min, bmi) as c1y,
        covar_pop(age, bmi) as c2y, avg(prim_min) as m1, avg(age) as m2, avg(bmi) as my,
        stddev_samp(prim_min) as sd1, stddev_samp(age) as sd2 from tr),
b as (select (v22 * c1y - v12 * c2y) / (v11 * v22 - v12 * v12) as b1,
        (v11 * c2y - v12 * c1y) / (v11 * v22 - v12 * v12) as b2, * from st),
coef as (select my - b1 * m1 - b2 * m2 as b0, * from b)"""

def _least_squares(source: str, features: list[str] = MODEL_FEATURES) -> str:
    """CTEs ending in ``coef``: ``b0`` and ``b1 .. bp`` of least squares of the
    label on ``features``, by sweeping the matrix of covariances feature by
    feature; ``sd1 .. sdp`` are the features' sample standard deviations."""
    p = len(features)
    x = {i: f for i, f in enumerate([*features, "bmi"], 1)}
    y = p + 1

    def a(i: int, j: int) -> str:
        return f"a{min(i, j)}_{max(i, j)}"

    cells = [(i, j) for i in x for j in x if i <= j]
    moments = ", ".join([f"covar_pop(cast({x[i]} as double), cast({x[j]} as double)) as {a(i, j)}" for i, j in cells]
                        + [f"avg({x[i]}) as m{i}" for i in x] + [f"stddev_samp({x[i]}) as sd{i}" for i in x])
    out, last = [f"ls0 as (select {moments} from {source})"], "ls0"
    for k in range(1, p + 1):
        d = a(k, k)
        swept = [f"-1 / {d} as {d}" if i == j == k else f"{a(i, j)} / {d} as {a(i, j)}" if k in (i, j)
                 else f"{a(i, j)} - {a(i, k)} * {a(k, j)} / {d} as {a(i, j)}" for i, j in cells]
        carry = ", ".join(f"m{i}, sd{i}" for i in x)
        out.append(f"ls{k} as (select {', '.join(swept)}, {carry} from {last})")
        last = f"ls{k}"
    slopes = ", ".join(f"{a(i, y)} as b{i}, sd{i}" for i in range(1, p + 1))
    intercept = f"m{y}" + "".join(f" - {a(i, y)} * m{i}" for i in range(1, p + 1))
    return ", " + ", ".join(out) + f", coef as (select {intercept} as b0, {slopes} from {last})"


PREDICTED = "b0" + "".join(f" + b{i} * {f}" for i, f in enumerate(MODEL_FEATURES, 1))


def _per_feature(columns: list[tuple[str, str]]) -> str:
    """Rows (feature, columns) from ``coef``; ``{i}`` stands for the feature's
    number, and the intercept is the same in every column."""
    rows = ["select 'intercept' as feature, " + ", ".join(f"round(b0, 6) as {n}" for n, _ in columns) + " from coef"]
    rows += [f"select '{f}', " + ", ".join(f"round({e.format(i=i)}, 6)" for _, e in columns) + " from coef"
             for i, f in enumerate(MODEL_FEATURES, 1)]
    return "\n" + "\nunion all ".join(rows)


# One-feature CV over fitIntercept, folds = hash % 3 on the training split.
CV = f""", cvd as (select *, cast({FOLD_HASH} % 3 as integer) as fold from tr),
fl as (select distinct fold from cvd),
fits as (select fl.fold, regr_slope(t.bmi, t.prim_min) as s1,
           regr_intercept(t.bmi, t.prim_min) as i1,
           sum(t.bmi * t.prim_min) / sum(t.prim_min * t.prim_min) as s0
         from fl join cvd t on t.fold <> fl.fold group by fl.fold),
log as (select v.fold, 0 as param_id, 'fitIntercept=true' as params,
          sqrt(avg(power(v.bmi - (f.i1 + f.s1 * v.prim_min), 2))) as metric
        from cvd v join fits f on v.fold = f.fold group by v.fold
        union all
        select v.fold, 1, 'fitIntercept=false', sqrt(avg(power(v.bmi - f.s0 * v.prim_min, 2)))
        from cvd v join fits f on v.fold = f.fold group by v.fold),
rk as (select param_id, params, avg(metric) as avg_metric, stddev_samp(metric) as std_metric,
         arg_max(metric, fold) as last_fold_metric, count(*) as folds,
         cast(row_number() over (order by avg(metric), params) as integer) as rank
       from log group by param_id, params),
full_fit as (select regr_slope(bmi, prim_min) as s1, regr_intercept(bmi, prim_min) as i1,
               sum(bmi * prim_min) / sum(prim_min * prim_min) as s0 from tr),
best_test as (select sqrt(avg(power(te.bmi - case when rk.param_id = 0
                    then ff.i1 + ff.s1 * te.prim_min else ff.s0 * te.prim_min end, 2))) as rmse
              from te, full_fit ff, (select * from rk where rank = 1) rk)"""

def _elastic_grid_sql() -> str:
    """The 6 x 10 grid as a VALUES table: param_id, label, alpha, lambda."""
    mixes = [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]
    regs = [i * 0.01 for i in range(10)]
    rows = []
    for a_i, a in enumerate(mixes):
        for r_i, r in enumerate(regs):
            label = f"elasticNetParam={a:.6g} regParam={r:.6g}"
            rows.append(f"({a_i * len(regs) + r_i}, '{label}', {a!r}E0, {r!r}E0)")
    return "(values " + ", ".join(rows) + ") as g(param_id, label, alpha, lam)"


# One-feature elastic net per fold, closed form on standardised moments:
# w' = sign(q) max(|q| - l1, 0) / (1 + l2), q = cov(x, y) / sd(x),
# l1 = lam * alpha, l2 = lam * (1 - alpha) / sd(y) (population moments).
ELASTIC_ONE = f""", cvd as (select *, cast({FOLD_HASH} % 3 as integer) as fold from tr),
fl as (select distinct fold from cvd),
st as (select fl.fold, avg(t.prim_min) as mx, avg(t.bmi) as my, var_pop(t.prim_min) as vx,
         var_pop(t.bmi) as vy, covar_pop(t.prim_min, t.bmi) as cxy
       from fl join cvd t on t.fold <> fl.fold group by fl.fold),
fit as (select st.*, g.param_id, g.label, sqrt(vx) as sx, cxy / sqrt(vx) as q,
          lam * alpha as l1, lam * (1 - alpha) / sqrt(vy) as l2
        from st cross join {_elastic_grid_sql()}),
coef as (select fold, param_id, label, mx, my,
           sign(q) * greatest(abs(q) - l1, 0) / (1 + l2) / sx as w from fit)
select c.fold, c.param_id, c.label as params,
  round(sqrt(avg(power(v.bmi - ((c.my - c.w * c.mx) + c.w * v.prim_min), 2))), 6) as metric
from cvd v join coef c on v.fold = c.fold
group by c.fold, c.param_id, c.label"""

def _elastic_all() -> str:
    """The grid on all features by cyclic coordinate descent in a recursive CTE:
    fold -1 is a fit on all training rows. Ends in ``log``, ``rk`` (as in ``CV``)
    and ``enet`` (fold, param_id, b0, b1 .. bp)."""
    x = dict(enumerate(MODEL_FEATURES, 1))
    p = len(x)
    pairs = [(i, j) for i in x for j in x if i < j]

    def g(i: int, j: int) -> str:
        return f"g{min(i, j)}_{max(i, j)}"

    moments = ", ".join([f"avg(t.{f}) as m{i}, stddev_pop(t.{f}) as s{i}, covar_pop(t.{f}, t.bmi) as c{i}" for i, f in x.items()]
                        + [f"covar_pop(cast(t.{x[i]} as double), cast(t.{x[j]} as double)) as k{i}_{j}" for i, j in pairs]
                        + ["avg(t.bmi) as my, stddev_pop(t.bmi) as sy"])
    scaled = ", ".join([f"c{i} / s{i} as q{i}" for i in x] + [f"k{i}_{j} / (s{i} * s{j}) as {g(i, j)}" for i, j in pairs])
    sweep = "(select r.k, r.fold, r.param_id, " + ", ".join(f"w{i}" for i in x) + ", p.* exclude (fold, param_id) " \
            "from cd r join pts p using (fold, param_id) where r.k < 250)"
    for i in x:  # each coordinate sees the new values of those before it
        rest = "".join(f" - {g(i, j)} * {'v' if j < i else 'w'}{j}" for j in x if j != i)
        sweep = (f"(select *, sign(r{i}) * greatest(abs(r{i}) - l1, 0) / (1 + l2) as v{i} "
                 f"from (select *, q{i}{rest} as r{i} from {sweep}))")
    return f""", cvd as (select *, cast({FOLD_HASH} % 3 as integer) as fold from tr),
fl as (select distinct fold from cvd union all select -1),
mo as (select fl.fold, {moments} from fl join cvd t on t.fold <> fl.fold group by fl.fold),
pts as (select mo.*, {scaled}, g.param_id, g.label, lam * alpha as l1, lam * (1 - alpha) / sy as l2
        from mo cross join {_elastic_grid_sql()}),
cd as (select 0 as k, fold, param_id, {", ".join(f"0E0 as w{i}" for i in x)} from pts
       union all select k + 1, fold, param_id, {", ".join(f"v{i}" for i in x)} from {sweep}),
enet as (select fold, param_id, label, {", ".join(f"w{i} / s{i} as b{i}, w{i} / s{i} * sd{i} as z{i}" for i in x)},
           my{"".join(f" - w{i} / s{i} * m{i}" for i in x)} as b0
         from cd join pts using (fold, param_id),
           (select {", ".join(f"stddev_samp({f}) as sd{i}" for i, f in x.items())} from tr) where k = 250),
log as (select v.fold, param_id, label as params, sqrt(avg(power(bmi - ({PREDICTED}), 2))) as metric
        from cvd v join enet e on v.fold = e.fold group by all),
rk as (select param_id, params, avg(metric) as avg_metric, stddev_samp(metric) as std_metric,
         arg_max(metric, fold) as last_fold_metric, count(*) as folds,
         cast(row_number() over (order by round(avg(metric), 12), params) as integer) as rank
       from log group by param_id, params),
tuned as (select enet.* from enet join rk using (param_id) where enet.fold = -1 and rk.rank = 1)"""


def _elastic(sql: str) -> str:
    return _edited(SPLIT + _elastic_all() + sql).replace("with survey as", "with recursive survey as", 1)


# All numeric columns but the label. ``activity_n`` equals ``exfreq`` on every cleaned
# row, so predictions are those of the others alone, and the shortest solution gives
# each of the two half of the effect.
ALL_COLUMNS = [n for n, _ in SURVEY_TYPES if n not in ("bmi", "activity_n")]
ALL_OLS = f"""
, e as (select * from edited where earn is null or earn <> -1),
r as (select *, row_number() over (order by {ORDER_HASH}, l_orderkey, activity_n,
                                            l_partkey, l_suppkey) as rn,
             count(*) over () as total from e),
tr as (select * from r where rn > ceil(3E-1 * total) and earn is not null),
te as (select * from r where rn <= ceil(3E-1 * total) and earn is not null){_least_squares("tr", ALL_COLUMNS)}"""


def _all_effects() -> str:
    rows = ["select 'intercept' as feature, round(b0, 4) + 0E0 as effect from coef"]
    for i, f in enumerate(ALL_COLUMNS, 1):
        share = f"round(b{i} * sd{i} / {2 if f == 'exfreq' else 1}, 6) + 0E0"
        rows += [f"select '{n}', {share} from coef" for n in ([f, "activity_n"] if f == "exfreq" else [f])]
    return "\n" + "\nunion all ".join(rows)


def _matrix_sql() -> str:
    names = ["bmi", "l_orderkey", "l_partkey", "l_suppkey", "activity_n", "prim_min", "sec_min", "soda", "exercise",
             "income", "exfreq", "age", "loc", "earn", "sex"]
    rows = []
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            x, y = f"cast({a} as double)", f"cast({b} as double)"
            rows.append(f"select '{a}' as col_x, '{b}' as col_y, count(*) as n, round(avg({x}), 6) as mean_x, round(avg({y}), 6) as mean_y, "
                        f"round(corr({x}, {y}), 6) + 0E0 as corr from survey where {a} is not null and {b} is not null")
    return with_survey("\nunion all\n".join(rows))


FOREST_HASH = _hash("fold")
SMALL_FOREST = SPLIT + forest.grown(3, 2, bins=8) + forest.placed("f_te", "0", 3, 2, "bt")
DEFAULT_FOREST = SPLIT + forest.grown(20, 5)
FOREST_CV = SPLIT + forest.searched([2, 4, 5, 8], [2, 3, 4, 5, 6], 4, FOREST_HASH)
BEST_RMSE = forest.rmse("bt", "trees", "depth", ", best")

RANK_COLS = ("param_id, params, round(avg_metric, 6) as avg_metric, "
             "round(std_metric, 6) as std_metric, round(last_fold_metric, 6) as last_fold_metric, "
             "folds, rank")

ORACLE: dict[str, str] = {
    "case_calendar": _cal(
        "select year, month, count(*) as rows from calendar group by year, month"),
    "monthly_mean_by_year": _cal(
        "select year, month, count(*) as rows, round(avg(exfreq), 6) as mean_exfreq "
        "from calendar where month is not null group by year, month"),
    "monthly_mean_all_years": _cal(
        "select month, count(*) as rows, round(avg(exfreq), 6) as mean_exfreq "
        "from calendar where month is not null group by month"),
    "monthly_mean_grouping_sets": _cal(
        "select year, month, cast(grouping(year, month) as integer) as level, "
        "count(*) as rows, round(avg(exfreq), 6) as mean_exfreq "
        "from calendar where month is not null "
        "group by grouping sets ((year, month), (month))"),
    "csv_profile": _csv_sql(),
    "csv_quarantine": with_survey(
        "select case when l_orderkey % 50 in (7, 13) then 'fields' else 'values' end as reason, "
        "case l_orderkey % 50 when 21 then 'bmi' when 33 then 'age' else '' end as columns, "
        "count(*) as lines, cast(sum(l_orderkey) as bigint) as sum_orderkey "
        "from survey where l_orderkey % 50 in (7, 13, 21, 33) group by 1, 2"),
    "preview_head": with_survey(
        f"select {ROUNDED_SURVEY_COLS} from survey "
        "order by case_id, l_orderkey, activity_n, l_partkey, l_suppkey limit 5"),
    "preview_tail": with_survey(
        f"select {ROUNDED_SURVEY_COLS} from survey order by case_id desc, l_orderkey desc, "
        "activity_n desc, l_partkey desc, l_suppkey desc limit 5"),
    "column_profile": _profile_sql(),
    "describe_numeric": _describe_sql(),
    "value_counts_with_null": with_survey(
        "select earn, count(*) as n from survey group by earn"),
    "value_counts": with_survey(
        "select soda, count(*) as n from survey where soda is not null group by soda"),
    "sentinel_share": _sentinel_sql(),
    "drop_sentinel_nullsafe": with_survey(
        f"select {ROUNDED_SURVEY_COLS} from survey where earn is null or earn <> -1"),
    "clean_survey": with_survey(
        "select l_orderkey, activity_n, l_partkey, l_suppkey, round(bmi, 6) as bmi, "
        "round(prim_min, 6) as prim_min, round(sec_min, 6) as sec_min, soda, exercise, "
        "age, income, exfreq, loc, sex "
        f"from survey where {CLEAN_WHERE}"),
    "cleaning_funnel": _funnel_sql(),
    "equal_width_bins": _edited(f"""
, r as (select min(cast(prim_min as double)) as lo, max(cast(prim_min as double)) as hi
        from edited where prim_min is not null),
b as (select {_bin('prim_min', 'lo', 'hi', 5)} as bin, lo, hi
      from edited, r where prim_min is not null)
select bin, {REFERENCE_LABELS_SQL}[bin] as bin_label,
  round(lo + (hi - lo) * (bin - 1) / 5, 6) as bin_lo, round(lo + (hi - lo) * bin / 5, 6) as bin_hi,
  count(*) as n
from b group by bin, lo, hi"""),
    "histogram": _edited(f"""
, r as (select min(cast(prim_min as double)) as lo, max(cast(prim_min as double)) as hi
        from edited where prim_min is not null),
c as (select {_bin('prim_min', 'lo', 'hi', 10)} as bin, count(*) as n
      from edited, r where prim_min is not null group by 1),
g as (select cast(range as integer) as bin from range(1, 11))
select g.bin, round(lo + (hi - lo) * (g.bin - 1) / 10, 6) as bin_lo,
  round(lo + (hi - lo) * g.bin / 10, 6) as bin_hi, coalesce(c.n, 0) as n
from g cross join r left join c on g.bin = c.bin"""),
    "box_stats_by_code": "with e as (select * from events)" + _box("e", ["event_type"], "value"),
    "box_stats_bmi_by_exercise": _edited(
        ", ex as (select * from edited where exercise in (1, 2))"
        + _box("ex", ["exercise"], "bmi")),
    "box_stats_by_bin": _binned_box("prim_min", "true"),
    "box_stats_by_earn_bin": _binned_box("earn", "(earn is null or earn <> -1)"),
    "box_stats_top_values": _edited(
        ", top as (select sec_min from edited group by sec_min "
        "order by count(*) desc, sec_min asc nulls first limit 25), "
        "ts as (select e.* from edited e join top using (sec_min))" + _box("ts", ["sec_min"], "bmi")),
    "box_stats_by_sex": _edited(", ed as (select * from edited)" + _box("ed", ["sex"], "bmi")),
    "box_stats_by_income": _edited(", ed as (select * from edited)" + _box("ed", ["income"], "bmi")),
    "box_stats_by_soda": _edited(", ed as (select * from edited)" + _box("ed", ["soda"], "bmi")),
    "joint_histogram": _edited(f"""
, e as (select * from edited where prim_min is not null and bmi is not null),
r as (select min(cast(prim_min as double)) as xlo, max(cast(prim_min as double)) as xhi,
             min(bmi) as ylo, max(bmi) as yhi, corr(prim_min, bmi) as corr from e),
c as (select {_bin('cast(prim_min as double)', 'xlo', 'xhi', 10)} as bin_x,
             {_bin('bmi', 'ylo', 'yhi', 10)} as bin_y, count(*) as n, any_value(r.corr) as corr
      from e, r group by 1, 2)
select bin_x, bin_y, n, cast(sum(n) over (partition by bin_x) as bigint) as n_x,
  cast(sum(n) over (partition by bin_y) as bigint) as n_y, round(corr, 6) as corr from c"""),
    "column_histograms": _edited(", parts as (" + " union all ".join(
        f"select '{c}' as column_name, {_bin(f'cast({c} as double)', 'lo', 'hi', 10)} as bin, lo, hi from edited, "
        f"(select min(cast({c} as double)) as lo, max(cast({c} as double)) as hi from edited)" for c in CLEAN_COLUMNS)
        + """)
select column_name, bin, round(lo + (hi - lo) * (bin - 1) / 10, 6) as bin_lo,
  round(lo + (hi - lo) * bin / 10, 6) as bin_hi, count(*) as n from parts where bin is not null group by all"""),
    "correlation_pairs": _corr_sql(),
    "top_values": _edited(
        "select round(sec_min, 6) as sec_min, count(*) as n from edited group by sec_min "
        "order by n desc, sec_min asc nulls first limit 25"),
    "rows_in_top_values": _edited(
        ", top as (select sec_min from edited group by sec_min "
        "order by count(*) desc, sec_min asc nulls first limit 25)\n"
        f"select {ROUNDED_SURVEY_COLS_E} from edited e where exists "
        "(select 1 from top t where t.sec_min is not distinct from e.sec_min)"),
    "split_counts": _edited(
        f"select {_split_summary(f'case when {SPLIT_HASH} % 100 < 70 then ' + chr(39) + 'train' + chr(39) + ' else ' + chr(39) + 'test' + chr(39) + ' end as split')} "
        "from edited group by 1"),
    "kfold_counts": _edited(
        f"select {_split_summary(f'cast({FOLD_HASH} % 3 as integer) as fold')} from edited group by 1"),
    "intercept_model_rmse": _edited(SPLIT + """
, m as (select avg(bmi) as mu from tr)
select 'intercept' as model, round(sqrt(avg(power(bmi - mu, 2))), 6) as rmse from te, m"""),
    "ols_one_feature": _edited(SPLIT + """
select 'ols' as model, 'intercept' as feature, round(regr_intercept(bmi, prim_min), 6) as coefficient
from tr
union all
select 'ols', 'prim_min', round(regr_slope(bmi, prim_min), 6) from tr"""),
    "ols_two_features": _edited(SPLIT + OLS2 + """
select 'ols2' as model, 'intercept' as feature, round(b0, 6) as coefficient from coef
union all select 'ols2', 'prim_min', round(b1, 6) from coef
union all select 'ols2', 'age', round(b2, 6) from coef"""),
    "ols_scaled": _edited(SPLIT + _least_squares("tr") + ", t as ("
                          + _per_feature([("coefficient", "b{i} * sd{i}")])
                          + ") select 'ols_scaled' as model, feature, coefficient from t"),
    "scaled_features": _edited(SPLIT + ", sd as (select " + ", ".join(
        f"stddev_samp({f}) as sd{i}" for i, f in enumerate(MODEL_FEATURES)) + " from tr)\nselect "
        + ", ".join(SURVEY_KEY) + ", " + ", ".join(
            f"round({f} / sd{i}, 6) as {f}_scaled" for i, f in enumerate(MODEL_FEATURES)) + " from tr, sd"),
    "coefficient_table": _edited(SPLIT + _least_squares("tr") + _per_feature(
        [("not_scaled", "b{i}"), ("scaled", "b{i} * sd{i}")])),
    "ols_r2": _edited(f"""
, e as (select * from edited where earn is null or earn <> -1),
r as (select *, row_number() over (order by {ORDER_HASH}, l_orderkey, activity_n,
                                            l_partkey, l_suppkey) as rn,
             count(*) over () as total from e),
tr as (select * from r where rn > ceil(3E-1 * total)),
te as (select * from r where rn <= ceil(3E-1 * total)){_least_squares("tr")},
m as (select avg(bmi) as mu from te)
select 'ols' as model,
  round(1 - sum(power(bmi - ({PREDICTED}), 2)) / sum(power(bmi - mu, 2)), 6) as r2
from te, coef, m"""),
    "ols_all_columns": _edited(ALL_OLS + f"""
, m as (select avg(bmi) as mu from te), twins as (select corr(activity_n, exfreq) as c from tr)
select 'ols' as model, cast({len(ALL_COLUMNS) + 1} as integer) as n_columns,
  cast({len(ALL_COLUMNS) + 1} - cast(any_value(c) > 1 - 1e-12 as integer) as integer) as rank,
  round(1 - sum(power(bmi - ({"b0" + "".join(f" + b{i} * {f}" for i, f in enumerate(ALL_COLUMNS, 1))}), 2)) / sum(power(bmi - mu, 2)), 6) as r2
from te, coef, m, twins"""),
    "ols_all_columns_effects": _edited(ALL_OLS + _all_effects()),
    "forest_stump_rmse": _edited(SPLIT + """
, v as (select prim_min as x, count(*) as n, sum(bmi) as s from tr group by prim_min),
c as (select x, sum(n) over w as nl, sum(s) over w as sl, sum(n) over () as nt, sum(s) over () as st
      from v window w as (order by x)),
best as (select x, sl / nl as low, (st - sl) / (nt - nl) as high from c where nt > nl
         order by sl * sl / nl + (st - sl) * (st - sl) / (nt - nl) desc limit 1)
select 'stump' as model, round(sqrt(avg(power(bmi - case when prim_min <= x then low else high end, 2))), 6) as rmse
from te, best"""),
    "forest_small_rmse": _edited(SMALL_FOREST + f"""
select 'forest' as model, round(rmse, 6) as rmse from {forest.rmse("bt", "3", "2")}"""),
    "forest_rmse": _edited(DEFAULT_FOREST + forest.placed("f_te", "0", 20, 5, "bt") + f"""
select 'forest' as model, round(rmse, 6) as rmse from {forest.rmse("bt", "20", "5")}"""),
    "forest_importances": _edited(DEFAULT_FOREST + f"""
select 'forest' as model, {forest.feature_name()} as feature, round(importance, 6) as importance
from {forest.importances(0, "20", "5")}"""),
    "forest_best_importances": _edited(FOREST_CV + forest.grown(20, 5, name="d") + f"""
select {forest.feature_name("a.f")} as feature, round(a.importance, 6) as forest, round(b.importance, 6) as forest_best
from {forest.importances(0, "20", "5", "d")} a join {forest.importances(4, "trees", "depth", "f", ", best")} b on a.f = b.f"""),
    "forest_cv": _edited(FOREST_CV + f"\nselect {RANK_COLS} from rk"),
    "forest_topk": _edited(FOREST_CV + f"\nselect {RANK_COLS} from rk where rank <= 5"),
    "forest_generalisation_ratio": _edited(FOREST_CV + f"""
select round(rmse, 6) as test_metric, round(avg_metric, 6) as best_cv, round(rmse / avg_metric, 6) as ratio
from {BEST_RMSE}, (select * from rk where rank = 1)"""),
    "importance_vs_coefficient": _edited(DEFAULT_FOREST + _least_squares("tr") + ", z as (" + " union all ".join(
        f"select {i} as f, abs(b{i + 1} * sd{i + 1}) as abs_coefficient from coef" for i in range(len(MODEL_FEATURES))) + f""")
select {forest.feature_name("z.f")} as feature, round(abs_coefficient, 6) as abs_coefficient, round(importance, 6) as importance
from z join {forest.importances(0, "20", "5")} i on i.f = z.f"""),
    "correlation_matrix": _matrix_sql(),
    "residual_sample": _edited(SPLIT + f"""
, f as (select regr_slope(bmi, prim_min) as s, regr_intercept(bmi, prim_min) as i from tr),
z as (select l_orderkey, activity_n, l_partkey, l_suppkey, round(i + s * prim_min, 6) as prediction,
        round(bmi - (i + s * prim_min), 6) as residual, {_hash("sample")} as h from te, f),
w as (select *, row_number() over (order by h, l_orderkey, activity_n, l_partkey, l_suppkey) as place,
        row_number() over (partition by activity_n order by h, l_orderkey, activity_n, l_partkey, l_suppkey) as own_place,
        count(*) over () as n, count(*) over (partition by activity_n) as own_n from z)
select l_orderkey, activity_n, l_partkey, l_suppkey, prediction, residual, round(n / least(n, 200), 6) as weight, 'all' as stratum
from w where place <= 200
union all
select l_orderkey, activity_n, l_partkey, l_suppkey, prediction, residual, round(own_n / least(own_n, 25), 6),
  'activity ' || activity_n from w where own_place <= 25"""),
    "ols_residuals": _edited(SPLIT + """
, f as (select regr_slope(bmi, prim_min) as s, regr_intercept(bmi, prim_min) as i from tr)
select l_orderkey, activity_n, l_partkey, l_suppkey, round(i + s * prim_min, 6) as prediction,
  round(bmi - (i + s * prim_min), 6) as residual
from te, f"""),
    "elastic_net_fold_metrics": _edited(SPLIT + ELASTIC_ONE),
    "elastic_net_cv": _elastic(f"\nselect {RANK_COLS} from rk"),
    "elastic_net_comparison": _elastic(_least_squares("tr") + f"""
select params as model, 'validation_mean' as metric_split, 'rmse' as metric, round(avg_metric, 6) as value
from rk where rank <= 3
union all select 'intercept', 'test', 'rmse', round(sqrt(avg(power(bmi - mu, 2))), 6)
from te, (select avg(bmi) as mu from tr)
union all select 'unscaled', 'test', 'rmse', round(sqrt(avg(power(bmi - ({PREDICTED}), 2))), 6) from te, coef
union all select 'tuned', 'test', 'rmse', round(sqrt(avg(power(bmi - ({PREDICTED}), 2))), 6) from te, tuned"""),
    "coefficient_table_tuned": _elastic(_least_squares("tr") + """
select 'intercept' as feature, round(coef.b0, 6) as not_scaled, round(coef.b0, 6) as scaled,
  round(tuned.b0, 6) as best_scaled from coef, tuned""" + "".join(
        f"\nunion all select '{f}', round(coef.b{i}, 6), round(coef.b{i} * sd{i}, 6), round(tuned.z{i}, 6) + 0E0 from coef, tuned"
        for i, f in enumerate(MODEL_FEATURES, 1))),
    "cv_fold_metrics_ols": _edited(SPLIT + CV + """
select fold, param_id, params, round(metric, 6) as metric from log"""),
    "cv_running_average": _edited(SPLIT + CV + """
select fold, param_id, params, round(metric, 6) as metric,
  round(avg(metric) over (partition by param_id order by fold
                          rows between unbounded preceding and current row), 6) as running_avg
from log"""),
    "cv_ranking": _edited(SPLIT + CV + f"\nselect {RANK_COLS} from rk"),
    "topk_configs": _edited(SPLIT + CV + f"\nselect {RANK_COLS} from rk where rank <= 3"),
    "model_comparison": _edited(SPLIT + CV + """
, m as (select avg(bmi) as mu from tr)
select 'intercept' as model, 'test' as metric_split, 'rmse' as metric,
  round(sqrt(avg(power(bmi - mu, 2))), 6) as value from te, m
union all
select 'ols', 'test', 'rmse', round(sqrt(avg(power(bmi - (ff.i1 + ff.s1 * prim_min), 2))), 6)
from te, full_fit ff
union all
select 'cv_best', 'validation_mean', 'rmse', round(avg_metric, 6) from rk where rank = 1
union all
select 'cv_best', 'test', 'rmse', round(rmse, 6) from best_test"""),
    "generalisation_ratio": _edited(SPLIT + CV + """
select round(bt.rmse, 6) as test_metric, round(rk.avg_metric, 6) as best_cv,
  round(bt.rmse / rk.avg_metric, 6) as ratio
from best_test bt, (select * from rk where rank = 1) rk"""),
    "exact_split_counts": _edited(f"""
, e as (select * from edited where earn is null or earn <> -1),
r as (select *, row_number() over (order by {ORDER_HASH}, l_orderkey, activity_n,
                                            l_partkey, l_suppkey) as rn,
             count(*) over () as total from e)
select {_split_summary("case when rn <= ceil(3E-1 * total) then 'test' else 'train' end as split")}
from r group by 1"""),
}
