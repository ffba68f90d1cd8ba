"""Independent SQL definitions (DuckDB dialect, ANSI where possible) of every
relational operator, over the driver tables. Used as the correctness oracle.

Conventions that make the two engines agree: double literals are written
``x.0E0``; floors of doubles stay doubles; computed doubles are rounded to 6
places and ``+ 0.0E0`` turns -0.0 into 0.0; integer sums are cast to BIGINT;
every ORDER BY states its NULL placement.
"""

from __future__ import annotations

from .. import schema as S
from ..sources.observations import REQUEST_TEXTS

# The F1 fixture view (FIXTURES.md), verbatim.
F1 = """SELECT t.*,
  least(ttf_comp1_weeks, ttf_comp2_weeks, ttf_comp3_weeks, ttf_comp4_weeks) < 2.0E0 / 7.0E0
    AS failure_within_48h
FROM (
  SELECT o.*,
    greatest(0.0E0, (60 - days_since_comp1_maint) / 7.0E0 + (200 - volt) / 25.0E0
      - error_count * 0.25E0) AS ttf_comp1_weeks,
    (60 - days_since_comp2_maint) / 7.0E0 + age * 0.125E0 AS ttf_comp2_weeks,
    (60 - days_since_comp3_maint) / 5.0E0 + (7 - error_count) * 0.5E0 AS ttf_comp3_weeks,
    (60 - days_since_comp4_maint) / 4.0E0 + (rotate - 300) / 100.0E0 AS ttf_comp4_weeks
  FROM (
    SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS obs_id,
      l_suppkey AS machineID,
      CASE WHEN p_partkey % 101 = 0 THEN NULL
           ELSE concat('model', CAST(1 + p_partkey % 4 AS varchar(10))) END AS model,
      150.0E0 + l_quantity AS volt,
      300.0E0 + l_extendedprice / 500.0E0 AS rotate,
      CASE WHEN l_orderkey % 37 = 0 THEN NULL ELSE 80.0E0 + p_size END AS pressure,
      CASE WHEN (l_orderkey + l_linenumber) % 41 = 0 THEN NULL
           ELSE 30.0E0 + 400.0E0 * l_discount END AS vibration,
      CAST((l_suppkey * 7) % 21 AS bigint) AS age,
      CAST(l_linenumber - 1 AS bigint) AS error_count,
      (l_orderkey * 3 + l_partkey) % 60 AS days_since_comp1_maint,
      (l_orderkey * 7 + l_partkey) % 60 AS days_since_comp2_maint,
      (l_orderkey * 11 + l_partkey) % 60 AS days_since_comp3_maint,
      (l_orderkey * 13 + l_partkey) % 60 AS days_since_comp4_maint
    FROM lineitem JOIN part ON l_partkey = p_partkey
  ) o
) t"""

T = S.TARGETS
FEATS = S.FEATURE_ORDER
NUM = [f for f in FEATS if f not in S.CATEGORICAL_FEATURES]


def r6(x: str) -> str:
    return f"(round({x}, 6) + 0.0E0)"


def d(x: float | int) -> str:
    """A double literal."""
    return f"{float(x)!r}E0" if "e" not in repr(float(x)) else repr(float(x))


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def bin_sql(x: str, mn: str, mx: str, labels) -> str:
    k = len(labels)
    parts = [f"WHEN {x} IS NULL THEN NULL", f"WHEN {mn} = {mx} THEN {q(labels[(k + 1) // 2 - 1])}"]
    for i in range(1, k):
        parts.append(f"WHEN {x} <= {mn} + {i}.0E0 * (({mx} - {mn}) / {k}.0E0) THEN {q(labels[i - 1])}")
    return "CASE " + " ".join(parts) + f" ELSE {q(labels[-1])} END"


def _alloc(src: str, stratum: str, draws: str, name: str) -> str:
    """Largest-remainder allocation CTEs over ``src`` grouped by ``stratum``."""
    return f"""
{name}_c AS (SELECT {stratum} AS stratum, count(*) AS n FROM {src} GROUP BY {stratum}),
{name}_t AS (SELECT stratum, n, CAST(sum(n) OVER () AS BIGINT) AS tot FROM {name}_c),
{name}_d AS (SELECT stratum, n, tot, {draws} AS draws FROM {name}_t),
{name}_s AS (SELECT stratum, n, tot, draws,
    CAST(n AS DOUBLE) / CAST(tot AS DOUBLE) * CAST(draws AS DOUBLE) AS share FROM {name}_d),
{name}_b AS (SELECT stratum, n, tot, draws, CAST(floor(share) AS BIGINT) AS base,
    share - floor(share) AS rem FROM {name}_s),
{name} AS (SELECT stratum, n, CAST(CASE WHEN draws >= tot THEN n ELSE base + CASE WHEN
    row_number() OVER (ORDER BY rem DESC, stratum ASC NULLS LAST) <= draws - sum(base) OVER ()
    THEN 1 ELSE 0 END END AS BIGINT) AS take FROM {name}_b)"""


def _hash(tag: str, key: str = "obs_id") -> str:
    return f"md5(concat({q(tag)}, CAST({key} AS VARCHAR)))"


def _split(src: str, name: str) -> str:
    """CTE ``name``: the rows of ``src`` as train and test rows."""
    return _alloc(src, "model", f"tot - CAST(ceil({S.TEST_FRACTION}E0 * tot) AS BIGINT)", f"{name}_p").lstrip() + f""",
{name} AS (SELECT r.* EXCLUDE (rn, take), CASE WHEN rn <= take THEN 'train' ELSE 'test' END AS split FROM (
    SELECT x.*, p.take, row_number() OVER (PARTITION BY x.model
        ORDER BY {_hash(f'{S.SEED}-split-', 'x.obs_id')}, x.obs_id) AS rn
    FROM {src} x JOIN {name}_p p ON x.model IS NOT DISTINCT FROM p.stratum) r)"""


_ROW_MEAN = ("(coalesce(ttf_comp1_weeks, 0.0E0) + coalesce(ttf_comp2_weeks, 0.0E0) + "
             "coalesce(ttf_comp3_weeks, 0.0E0) + coalesce(ttf_comp4_weeks, 0.0E0))")
_ROW_N = " + ".join(f"CAST({t} IS NOT NULL AS INTEGER)" for t in T)

_STRATUM = (
    "concat_ws('_', coalesce(CAST(model AS VARCHAR), 'nan'), "
    f"coalesce({bin_sql('mean_ttf', 'mn_t', 'mx_t', S.TTF_RANGE_LABELS)}, 'nan'), "
    f"coalesce({bin_sql('CAST(age AS DOUBLE)', 'mn_a', 'mx_a', S.AGE_GROUP_LABELS)}, 'nan'), "
    f"coalesce({bin_sql('CAST(error_count AS DOUBLE)', 'mn_e', 'mx_e', S.ERROR_LEVEL_LABELS)}, 'nan'))"
)

_MED = ", ".join(f"median(CAST({c} AS DOUBLE)) AS {c}" for c in NUM)
_PROC = ", ".join(
    ["CAST(cls.code AS DOUBLE) AS model"]
    + [f"coalesce(CAST(sp.{c} AS DOUBLE), med.{c}) AS {c}" for c in NUM])
_SC = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in FEATS)


def scaled_sql(c: str) -> str:
    return f"(p.{c} - sc.m_{c}) / CASE WHEN sc.s_{c} = 0 THEN 1.0E0 ELSE sc.s_{c} END"


_ORDER = "CAST(split_part(obs_id, '-', 1) AS BIGINT)"


def _text(f: str) -> str:
    """A request text of F3 with what FIXTURES.md plants in it."""
    planted = " ".join(f"WHEN {_ORDER} % {m} = 0 THEN {q(t)}" for m, c, t in reversed(REQUEST_TEXTS) if c == f)
    return f"CASE {planted} ELSE CAST({f} AS VARCHAR) END" if planted else f"CAST({f} AS VARCHAR)"


BASE = f"""WITH obs AS ({F1}),
rm AS (SELECT obs.*, CASE WHEN ({_ROW_N}) > 0 THEN {_ROW_MEAN} / ({_ROW_N}) END AS mean_ttf FROM obs),
st AS (SELECT min(mean_ttf) AS mn_t, max(mean_ttf) AS mx_t,
    min(CAST(age AS DOUBLE)) AS mn_a, max(CAST(age AS DOUBLE)) AS mx_a,
    min(CAST(error_count AS DOUBLE)) AS mn_e, max(CAST(error_count AS DOUBLE)) AS mx_e FROM rm),
lab AS (SELECT rm.*,
    {bin_sql('mean_ttf', 'mn_t', 'mx_t', S.TTF_RANGE_LABELS)} AS ttf_range,
    {bin_sql('CAST(age AS DOUBLE)', 'mn_a', 'mx_a', S.AGE_GROUP_LABELS)} AS age_group,
    {bin_sql('CAST(error_count AS DOUBLE)', 'mn_e', 'mx_e', S.ERROR_LEVEL_LABELS)} AS error_level,
    {_STRATUM} AS stratum FROM rm, st),
{_alloc('lab', 'stratum', 'CAST(floor(0.2E0 * tot) AS BIGINT)', 'salloc')},
samp AS (SELECT r.* EXCLUDE (rn, take) FROM (
    SELECT lab.*, salloc.take, row_number() OVER (PARTITION BY lab.stratum
        ORDER BY {_hash(f'{S.SEED}-', 'lab.obs_id')}, lab.obs_id) AS rn
    FROM lab JOIN salloc ON lab.stratum = salloc.stratum) r WHERE rn <= take),
{_split('samp', 'ssplit')},
{_split('obs', 'split')},
train AS (SELECT * FROM split WHERE split = 'train'),
test AS (SELECT * FROM split WHERE split = 'test'),
cls AS (SELECT v AS class, CAST(row_number() OVER (ORDER BY v ASC NULLS LAST) - 1 AS BIGINT) AS code
    FROM (SELECT DISTINCT coalesce(CAST(model AS VARCHAR), 'unknown') AS v FROM train
          UNION SELECT 'unknown') c),
med AS (SELECT {_MED} FROM train),
proc AS (SELECT sp.obs_id, sp.split, {_PROC} FROM split sp
    LEFT JOIN cls ON coalesce(CAST(sp.model AS VARCHAR), 'unknown') = cls.class, med),
sc AS (SELECT {_SC} FROM proc WHERE split = 'train'),
scaled AS (SELECT p.obs_id, p.split, {", ".join(f"{scaled_sql(c)} AS {c}" for c in FEATS)} FROM proc p, sc),
pred AS (SELECT split.*, {", ".join(f"{t} * 0.9E0 - 0.6E0 AS {S.pred_col(t)}" for t in T)} FROM split),
predall AS (SELECT obs.*, {", ".join(f"{t} * 0.9E0 - 0.6E0 AS {S.pred_col(t)}" for t in T)} FROM obs),
req AS (SELECT obs_id AS request_id, {_ORDER} AS k, {", ".join(f"{_text(f)} AS {f}" for f in FEATS)} FROM obs)
"""


def _long(src: str, extra: str = "") -> str:
    parts = []
    for t in T:
        parts.append(f"SELECT obs_id{extra}, '{t}' AS target, floor({t}) AS actual, "
                     f"{S.pred_col(t)} AS predicted FROM {src}")
    return " UNION ALL ".join(parts)


def _metrics() -> str:
    def r2(lbl):
        return (f"CASE WHEN count_if(split = '{lbl}') = 0 THEN NULL "
                f"WHEN var_pop(CASE WHEN split = '{lbl}' THEN actual END) * count_if(split = '{lbl}') = 0 "
                f"THEN CASE WHEN sum(CASE WHEN split = '{lbl}' THEN (actual - predicted) * (actual - predicted) END) = 0 "
                f"THEN 1.0E0 ELSE 0.0E0 END "
                f"ELSE 1.0E0 - sum(CASE WHEN split = '{lbl}' THEN (actual - predicted) * (actual - predicted) END) "
                f"/ (var_pop(CASE WHEN split = '{lbl}' THEN actual END) * count_if(split = '{lbl}')) END")

    def rmse(lbl):
        return (f"sqrt(sum(CASE WHEN split = '{lbl}' THEN (actual - predicted) * (actual - predicted) END) "
                f"/ count_if(split = '{lbl}'))")

    def mae(lbl):
        return f"avg(CASE WHEN split = '{lbl}' THEN abs(actual - predicted) END)"

    def mape(lbl):
        return (f"avg(CASE WHEN split = '{lbl}' THEN abs(actual - predicted) / greatest(actual, 1.0E0) END)"
                " * 100")

    st = f"split = 'test' AND actual < {S.SHORT_TERM_WEEKS}.0E0"
    return f"""mlong AS ({_long('pred', ', split')}),
met AS (SELECT target AS "Target",
  {rmse('train')} AS "Train_RMSE", {rmse('test')} AS "Test_RMSE",
  {mae('train')} AS "Train_MAE", {mae('test')} AS "Test_MAE",
  {r2('train')} AS "Train_R2", {r2('test')} AS "Test_R2",
  {mape('train')} AS "Train_MAPE", {mape('test')} AS "Test_MAPE",
  coalesce(avg(CASE WHEN {st} THEN abs(actual - predicted) END), 0.0E0) AS "Short_Term_MAE",
  coalesce(avg(CASE WHEN {st} THEN abs(actual - predicted) / greatest(actual, 1.0E0) END) * 100, 0.0E0)
    AS "Short_Term_MAPE",
  CAST(count_if({st}) AS BIGINT) AS "Short_Term_Count"
  FROM mlong GROUP BY target),
metrics AS (SELECT *, "Train_R2" - "Test_R2" AS "Overfitting" FROM met)"""


def _with(*ctes: str) -> str:
    return BASE + "".join(f",\n{c}" for c in ctes)


def _r6cols(cols, src_prefix: str = "") -> str:
    return ", ".join(f"{r6(src_prefix + c)} AS {c}" for c in cols)


def _floor_summary(src: str) -> str:
    fl = [f"floor({S.pred_col(t)})" for t in T]
    return (f"least({', '.join(fl)}) AS min_weeks, ({' + '.join(fl)}) / {len(T)}.0E0 AS avg_weeks, "
            f"greatest({', '.join(fl)}) AS max_weeks, CAST("
            + " + ".join(f"CAST({f} <= 2 AS INTEGER)" for f in fl)
            + f" AS BIGINT) AS critical_components, CAST({len(T)} AS BIGINT) AS total_components")


def _status(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} = 0 THEN 'CRITICAL' WHEN {x} <= 2 THEN 'URGENT' "
            f"WHEN {x} <= 4 THEN 'SOON' WHEN {x} <= 8 THEN 'NORMAL' ELSE 'GOOD' END")


def _rec(x: str, part: int) -> str:
    r = S.RECOMMENDATIONS
    return (f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} = 0 THEN {q(r['critical'][part])} "
            f"WHEN {x} <= 2 THEN {q(r['urgent'][part])} WHEN {x} <= 4 THEN {q(r['soon'][part])} "
            f"WHEN {x} <= 8 THEN {q(r['normal'][part])} ELSE {q(r['good'][part])} END")


def _guidance() -> str:
    parts = ["WHEN type = 'categorical' THEN NULL"]
    for k, v in S.GUIDANCE.items():
        parts.append(f"WHEN name = {q(k)} THEN {q(v)}")
    parts.append("WHEN contains(name, 'days_since') THEN concat('Days since ', "
                 "split_part(name, '_', 3), ' maintenance')")
    return "CASE " + " ".join(parts) + " ELSE '' END"


def _log_cols(src: str) -> str:
    cols = [f"'{LOG_TS}' AS timestamp", f"'{S.MODEL_VERSION}' AS model_version"]
    cols += [f"{src}.{f}" for f in FEATS]
    for t in T:
        cols += [f"floor({S.pred_col(t)}) AS {S.floor_col(t)}", f"{S.pred_col(t)} AS {S.exact_col(t)}"]
    fl = [f"floor({S.pred_col(t)})" for t in T]
    cols += [f"least({', '.join(fl)}) AS min_ttf_weeks",
             f"({' + '.join(fl)}) / {len(T)}.0E0 AS avg_ttf_weeks",
             f"greatest({', '.join(fl)}) AS max_ttf_weeks",
             "CAST(" + " + ".join(f"CAST({f} <= 2 AS INTEGER)" for f in fl) + " AS BIGINT) AS critical_components"]
    return ", ".join(cols)


LOG_TS = "2024-01-20 10:30:00"


def _coerce(f: str) -> tuple[str, str]:
    t = f"trim({f}, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)))"
    missing = (f"({f} IS NULL OR {f} = '' OR lower({f}) IN ('nan', 'null', 'none') "
               f"OR lower({t}) IN ('nan', '+nan', '-nan'))")
    num = f"CASE WHEN regexp_full_match({t}, '{S.NUMBER_PATTERN}') THEN TRY_CAST({t} AS DOUBLE) END"
    finite = f"({num} IS NOT NULL AND NOT isnan({num}) AND abs({num}) <> 'infinity'::DOUBLE)"
    value = f"CASE WHEN {missing} THEN NULL WHEN {finite} THEN {num} END"
    bad = f"(NOT {missing} AND NOT coalesce({finite}, false))"
    return value, bad


def _coerce_select() -> str:
    vals, errs = [], []
    for f in NUM:
        v, b = _coerce(f)
        vals.append(f"{v} AS {f}")
        errs.append(f"WHEN {b} THEN concat('could not convert string to float: {f}=''', {f}, '''')")
    err = "CASE " + " ".join(errs) + " END"
    return ", ".join(vals), err


def queries() -> dict[str, str]:
    out: dict[str, str] = {}
    out["scan_observations"] = _with() + (
        f"SELECT * REPLACE (CASE WHEN {_ORDER} % 43 = 0 OR {_ORDER} % 47 = 0 OR {_ORDER} % 49 = 0 "
        "THEN NULL ELSE volt END AS volt) FROM obs")
    out["unreadable_fields"] = _with() + (
        f"SELECT obs_id, 'volt' AS field, CASE WHEN {_ORDER} % 47 = 0 THEN 'inf' ELSE 'bad' END AS text, "
        f"CASE WHEN {_ORDER} % 47 = 0 THEN 'not finite' ELSE 'not a number' END AS reason FROM obs "
        f"WHERE {_ORDER} % 43 <> 0 AND ({_ORDER} % 47 = 0 OR {_ORDER} % 49 = 0)")
    # Lines by order key: blank, cut off, without an id, without volt.
    shown = "CASE WHEN k % 83 = 0 OR k % 89 = 0 OR k % 97 = 0 THEN 'md5' ELSE request_id END AS request_id"
    body = ("CASE WHEN k % 83 = 0 THEN 'empty request body' WHEN k % 89 = 0 THEN 'malformed request body' END")
    no_volt = "k % 83 <> 0 AND k % 89 <> 0 AND k % 97 <> 0 AND k % 101 = 0"
    lost = "k % 83 = 0 OR k % 89 = 0"
    texts = ", ".join(f"CASE WHEN {lost}{f' OR ({no_volt})' if f == 'volt' else ''} THEN NULL ELSE {f} END AS {f}"
                      for f in FEATS)
    out["scan_requests"] = _with() + (
        f"SELECT {shown}, {texts}, CASE WHEN {lost} THEN NULL WHEN {no_volt} THEN 'volt' ELSE '' END "
        f"AS absent_features, {body} AS error FROM req")
    out["select_features"] = _with() + f"SELECT obs_id, {', '.join(FEATS)}, {', '.join(T)} FROM obs"
    feats_rows = ", ".join(
        f"({i}, {q(f)}, {q('categorical' if f in S.CATEGORICAL_FEATURES else 'numerical')})"
        for i, f in enumerate(FEATS))
    out["feature_kinds"] = _with(
        f"fl AS (SELECT * FROM (VALUES {feats_rows}) v(position, name, type))",
        "opts AS (SELECT string_agg(class, ',' ORDER BY class ASC NULLS LAST) AS o FROM cls)") + (
        f"SELECT CAST(position AS INTEGER) AS position, name, type, "
        f"CASE WHEN type = 'categorical' THEN (SELECT count(*) FROM cls) ELSE 0 END AS n_options, "
        f"CASE WHEN type = 'categorical' THEN (SELECT o FROM opts) END AS options, "
        f"{_guidance()} AS guidance FROM fl")
    out["feature_options"] = _with() + "SELECT 'model' AS feature, code AS position, class AS option FROM cls"
    vals, err = _coerce_select()
    out["coerce_numeric"] = _with() + f"SELECT request_id, model, {vals}, {err} AS error FROM req"
    out["known_category"] = _with() + (
        "SELECT request_id, model, coalesce(model, 'unknown') IN (SELECT class FROM cls) AS known FROM req")
    why = f"coalesce({body}, CASE WHEN {no_volt} THEN 'missing feature(s): volt' END, {err})"
    out["validate_request"] = _with() + f"SELECT {shown}, ({why}) IS NULL AS success, {why} AS error FROM req"
    out["score_fleet"] = _with() + (
        f"SELECT request_id, model, {vals}, ({err}) IS NULL AS success, {err} AS error, "
        f"CASE WHEN ({err}) IS NULL THEN {len(T)} ELSE 0 END AS n_predictions FROM req")
    out["short_term_rows"] = _with() + (
        f"SELECT obs_id, {', '.join(f'floor({t}) AS {t}' for t in T)} FROM obs "
        f"WHERE least({', '.join(f'floor({t})' for t in T)}) < {S.SHORT_TERM_WEEKS}.0E0")
    short = f"least({', '.join(f'floor({t})' for t in T)}) < {S.SHORT_TERM_WEEKS}.0E0"
    out["sample_predictions"] = _with(
        f"cand AS (SELECT pred.*, CAST({short} AS INTEGER) AS is_short, {_hash(f'{S.SEED}-')} AS h "
        f"FROM pred WHERE split = 'test')",
        f"top AS (SELECT * FROM cand ORDER BY is_short DESC, h ASC, obs_id ASC LIMIT {S.SAMPLE_SHOWN})",
        "picked AS (SELECT * FROM top WHERE is_short = (SELECT max(is_short) FROM top))",
        f"pl AS ({_long('picked')})") + (
        "SELECT obs_id, target, actual, predicted, " + r6("abs(actual - predicted)") + " AS abs_error, "
        + r6("abs(actual - predicted) / greatest(actual, 1.0E0) * 100") + " AS error_pct, "
        f"CASE WHEN actual < {S.SHORT_TERM_WEEKS}.0E0 THEN 'Yes' ELSE 'No' END AS short_term FROM pl")
    out["row_mean_ttf"] = _with() + "SELECT obs_id, mean_ttf FROM rm"
    out["equal_width_bins"] = _with() + "SELECT obs_id, ttf_range, age_group, error_level FROM lab"
    out["strata_labels"] = _with() + "SELECT obs_id, stratum FROM lab"
    out["strata_count"] = _with() + "SELECT count(DISTINCT stratum) AS n_strata FROM lab"
    out["strata_sizes"] = _with() + "SELECT stratum, n, take FROM salloc"
    out["sample_report"] = _with() + (
        "SELECT (SELECT count(*) FROM obs) AS full_rows, (SELECT count(*) FROM samp) AS sample_rows, "
        + r6("(SELECT count(*) FROM samp) / (SELECT count(*) FROM obs) * 100") + " AS sample_pct, "
        "CAST(count_if(split = 'train') AS BIGINT) AS train_rows, "
        "CAST(count_if(split = 'test') AS BIGINT) AS test_rows, "
        + r6("count_if(split = 'train') / count(*) * 100") + " AS train_pct, "
        + r6("count_if(split = 'test') / count(*) * 100") + " AS test_pct FROM ssplit")
    out["stratified_sample"] = _with() + "SELECT obs_id, stratum FROM samp"
    out["train_test_split"] = _with() + "SELECT obs_id, model, split FROM split"
    miss = " UNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS feature, CAST(count_if({c} IS NULL) AS BIGINT) AS n_missing, "
        f"{r6(f'count_if({c} IS NULL) / count(*) * 100')} AS pct_missing FROM train"
        for i, c in enumerate(NUM))
    out["missing_report"] = _with(f"mr AS ({miss})") + "SELECT * FROM mr WHERE n_missing > 0"
    tfs = " UNION ALL ".join(
        f"SELECT '{t}' AS target, {r6(f'avg({t})')} AS orig_mean, {r6(f'stddev_samp({t})')} AS orig_std, "
        f"{r6(f'avg(floor({t}))')} AS floor_mean, {r6(f'stddev_samp(floor({t}))')} AS floor_std FROM train"
        for t in T)
    out["target_floor_stats"] = _with() + tfs
    chk = " UNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS feature, {r6(f'avg({c})')} AS mean, "
        f"{r6(f'stddev_pop({c})')} AS std FROM scaled WHERE split = 'train'"
        for i, c in enumerate(FEATS[:5]))
    out["scaling_check"] = _with() + chk
    out["impute_fit"] = _with() + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {r6(f'med.{c}')} AS median FROM med" for c in NUM)
    out["encode_fit"] = _with() + "SELECT class, code FROM cls"
    out["encode_transform"] = _with() + (
        "SELECT sp.obs_id, sp.split, sp.model, CAST(cls.code AS DOUBLE) AS model_code FROM split sp "
        "LEFT JOIN cls ON coalesce(CAST(sp.model AS VARCHAR), 'unknown') = cls.class")
    nmiss = " + ".join(f"CAST(sp.{c} IS NULL AS INTEGER)" for c in NUM)
    out["impute_transform"] = _with() + (
        f"SELECT p.obs_id, p.split, {', '.join(f'p.{c}' for c in NUM)}, {nmiss} AS n_missing "
        "FROM proc p JOIN split sp ON p.obs_id = sp.obs_id")
    out["scale_features"] = _with() + f"SELECT obs_id, split, {_r6cols(FEATS)} FROM scaled"
    out["floor_targets"] = _with() + f"SELECT obs_id, {', '.join(f'floor({t}) AS {t}' for t in T)} FROM obs"
    out["predictions_long"] = _with() + _long("pred", ", split")
    mcols = ["Train_RMSE", "Test_RMSE", "Train_MAE", "Test_MAE", "Train_R2", "Test_R2",
             "Train_MAPE", "Test_MAPE", "Short_Term_MAE", "Short_Term_MAPE"]

    def mr(cols):
        return ", ".join(f'{r6(chr(34) + c + chr(34))} AS "{c}"' for c in cols)

    out["metrics_by_target"] = _with(_metrics()) + (
        f'SELECT "Target", {mr(mcols)}, "Short_Term_Count", {r6(chr(34) + "Overfitting" + chr(34))} '
        'AS "Overfitting" FROM metrics')
    out["short_term_metrics"] = _with(_metrics()) + (
        f'SELECT "Target", {mr(["Short_Term_MAE", "Short_Term_MAPE"])}, "Short_Term_Count" FROM metrics')
    out["overfitting"] = _with(_metrics()) + (
        f'SELECT "Target", {mr(["Train_R2", "Test_R2", "Overfitting"])} FROM metrics')
    ocols = ["Test_RMSE", "Test_MAE", "Test_R2", "Test_MAPE", "Short_Term_MAE", "Short_Term_MAPE",
             "Overfitting"]
    out["metrics_overall"] = _with(_metrics()) + (
        "SELECT count(*) AS n_targets, "
        + ", ".join(f'{r6(f"avg({chr(34)}{c}{chr(34)})")} AS avg_{c}' for c in ocols) + " FROM metrics")
    out["metrics_table"] = _with(_metrics()) + (
        'SELECT "Target", ' + ", ".join(f'round("{c}", 4) + 0.0E0 AS "{c}"' for c in
                                        ["Test_RMSE", "Test_MAE", "Test_R2", "Test_MAPE"]) + " FROM metrics")
    out["efficiency"] = _with() + (
        f"SELECT CAST({len(FEATS)} AS BIGINT) AS n_features, CAST(count_if(split = 'train') AS BIGINT) AS train_rows, "
        f"CAST({S.REFERENCE_PARAMS['n_estimators'] * len(T)} AS BIGINT) AS n_estimators_total FROM split")
    cs = " UNION ALL ".join(
        f"SELECT obs_id, '{t}' AS target, '{S.component_name(t)}' AS component, "
        f"{S.pred_col(t)} AS exact_weeks, floor({S.pred_col(t)}) AS floor_weeks, "
        f"{_status(f'floor({S.pred_col(t)})')} AS status FROM predall" for t in T)
    out["component_status"] = _with() + cs
    out["machine_summary"] = _with() + f"SELECT obs_id, {_floor_summary('predall')} FROM predall"
    mn = "least(" + ", ".join(f"floor({S.pred_col(t)})" for t in T) + ")"
    out["recommendation"] = _with() + (
        f"SELECT obs_id, {mn} AS min_weeks, {_rec(mn, 0)} AS title, {_rec(mn, 1)} AS detail FROM predall")
    pr = " UNION ALL ".join(
        f"SELECT obs_id, {i} AS ordinal, '{S.component_name(t)}' AS component, "
        f"floor({S.pred_col(t)}) AS floor_weeks FROM predall" for i, t in enumerate(T))
    out["component_priority"] = _with(f"pr AS ({pr})") + (
        "SELECT obs_id, CAST(row_number() OVER (PARTITION BY obs_id ORDER BY floor_weeks ASC NULLS LAST, "
        "ordinal ASC) AS BIGINT) AS priority_rank, component, floor_weeks, "
        "CASE WHEN floor_weeks <= 2 THEN 'HIGH' WHEN floor_weeks <= 4 THEN 'MEDIUM' ELSE 'LOW' END "
        "AS priority FROM pr")
    statuses = ", ".join(_status(f"floor({S.pred_col(t)})") for t in T)
    failed, lost = f"{_ORDER} % 53 = 0", f"{_ORDER} % 59 = 0"
    none = f"({failed} OR {lost})"
    good = lambda x: f"CASE WHEN NOT {none} THEN {x} END"
    urgent = " + ".join(f"CAST(floor({S.pred_col(t)}) <= 2 AS INTEGER)" for t in T)
    out["prediction_response"] = _with() + (
        f"SELECT obs_id, NOT {none} AS success, CASE WHEN {failed} THEN 'bad volt' WHEN {lost} THEN 'no prediction' END "
        f"AS error, CAST(CASE WHEN {none} THEN 0 ELSE {len(T)} END AS INTEGER) AS n_results, "
        + good(f"concat_ws(',', {statuses})") + " AS statuses, " + good(mn) + " AS min_weeks, "
        + good(f"({' + '.join(f'floor({S.pred_col(t)})' for t in T)}) / {len(T)}.0E0") + " AS avg_weeks, "
        + good(f"CAST({urgent} AS DOUBLE)") + " AS critical_components, "
        + good(f"{len(T)}.0E0") + " AS total_components, "
        + good(_rec(mn, 0)) + " AS title, " + good(_rec(mn, 1)) + " AS detail, "
        + good(_rec(mn, 0)) + " AS json_title, " + good(f"'{S.component_name(T[3])}'") + " AS json_component, "
        "true AS json_reads_back FROM predall")
    out["log_rows"] = _with() + f"SELECT {_log_cols('predall')} FROM predall"
    out["log_scan"] = out["log_rows"]
    out["log_union"] = _with(
        f"lg AS (SELECT {_log_cols('pred')}, pred.split FROM pred)") + (
        "SELECT * EXCLUDE (split, max_ttf_weeks), max_ttf_weeks FROM lg WHERE split = 'test' "
        "UNION ALL SELECT * EXCLUDE (split, max_ttf_weeks), CAST(NULL AS DOUBLE) AS max_ttf_weeks "
        "FROM lg WHERE split = 'train'")
    out["fleet_status_counts"] = _with(f"cs AS ({cs})") + (
        "SELECT component, status, count(*) AS n_machines FROM cs GROUP BY component, status")
    fold = lambda k: f"CAST(('0x' || substr({_hash(f'{S.SEED}-fold-')}, 1, 15))::BIGINT % {k} AS INTEGER)"
    out["fold_assignment"] = _with() + f"SELECT obs_id, {fold(5)} AS fold FROM obs"
    quart = ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), {p}) AS {c}_{n}" for c in NUM for p, n in ((0.25, "q1"), (0.75, "q3")))
    out["outlier_flags"] = _with(f"qq AS (SELECT {quart} FROM obs)") + "SELECT obs_id, " + ", ".join(
        f"CAST({c} < {c}_q1 - 1.5E0 * ({c}_q3 - {c}_q1) OR {c} > {c}_q3 + 1.5E0 * ({c}_q3 - {c}_q1) AS VARCHAR) "
        f"AS {c}_outlier"
        for c in NUM) + " FROM obs, qq"
    corr = " UNION ALL ".join(
        f"SELECT '{t}' AS \"Target\", '{f}' AS \"Feature\", abs(corr(CAST({f} AS DOUBLE), floor({t}))) AS a FROM obs"
        for t in T for f in NUM)
    out["topk_importance"] = _with(
        f"co AS ({corr})", f'im AS (SELECT "Target", "Feature", {r6('a / sum(a) OVER (PARTITION BY "Target")')} AS "Importance" FROM co)',
        'rk AS (SELECT *, row_number() OVER (PARTITION BY "Target" ORDER BY "Importance" DESC, "Feature" ASC) AS rank FROM im)') + (
        f'SELECT "Target", "Feature", "Importance", CAST(rank AS INTEGER) AS rank FROM rk WHERE rank <= {S.TOP_K_FEATURES}')
    held = [f"sp.{f} AS orig_{f}" for f in FEATS] + [f"p.{f} AS proc_{f}" for f in FEATS]
    held += [f"{r6(f'c.{f}')} AS scaled_{f}" for f in FEATS] + [f"sp.{t} AS {t}_orig" for t in T]
    held += [f"floor(sp.{t}) AS {t}_floor" for t in T] + [f"sp.{t} * 0.9E0 - 0.6E0 AS {S.pred_col(t)}" for t in T]
    out["holdout_table"] = _with() + (
        f"SELECT sp.obs_id, {', '.join(held)} FROM split sp JOIN proc p ON sp.obs_id = p.obs_id "
        "JOIN scaled c ON sp.obs_id = c.obs_id WHERE sp.split = 'test'")
    out["stream_status"] = out["component_status"]
    out["stream_score"] = _with() + (
        f"SELECT {shown}, ({why}) IS NULL AS success, {why} AS error, "
        f"CAST(CASE WHEN ({why}) IS NULL THEN {len(T)} ELSE 0 END AS INTEGER) AS n_predictions FROM req")
    out["fit_facts"] = _with() + " UNION ALL ".join(
        f"SELECT '{t}' AS target, count(*) AS test_rows, count(*) AS predicted_rows, true AS beats_mean FROM test" for t in T)
    out["importance_facts"] = " UNION ALL ".join(
        f"SELECT '{t}' AS \"Target\", CAST({len(FEATS)} AS BIGINT) AS n_features, CAST(0 AS BIGINT) AS n_negative, "
        "1.0E0 AS total" for t in T)
    out["cross_validation_fit"] = _with() + " UNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS fold, '{t}' AS \"Target\", "
        f"CAST(count_if(floor({t}) < {S.SHORT_TERM_WEEKS}) AS BIGINT) AS \"Short_Term_Count\", true AS fits "
        f"FROM obs WHERE {fold(2)} = {i}" for t in T for i in range(2))
    each = " UNION ALL ".join(
        f"SELECT predall.*, {i} AS fold, CASE WHEN {fold(3)} = {i} THEN 'test' ELSE 'train' END AS split FROM predall"
        for i in range(3))
    cv = _metrics().replace("FROM pred", "FROM cvrows").replace("obs_id, split", "obs_id, fold, split").replace(
        'target AS "Target"', 'fold, target AS "Target"').replace("GROUP BY target", "GROUP BY fold, target")
    out["cross_validation"] = _with(f"cvrows AS ({each})", cv) + (
        f'SELECT CAST(fold AS INTEGER) AS fold, "Target", {mr([*mcols, "Overfitting"])}, "Short_Term_Count" FROM metrics')
    return out
