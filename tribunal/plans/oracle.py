"""The registered queries as plain SQL over the same tables.

Used only to check results; nothing in the library reads this module.
"""

from __future__ import annotations

from itertools import combinations

from tribunal.functions import rules

_DOCS = """docs as (
    select l.doc_id, d.n_chars,
           length(regexp_replace(d.text, '[A-Za-z ]', '', 'g'))::double / length(d.text) as odd_share,
           d.lang, d.source, l.quality
    from labels l join documents d on l.doc_id = d.doc_id)"""

_NULLS = """nulls as (
    select l_orderkey, l_linenumber,
           case when l_linenumber <= 3 then l_quantity end as mostly_missing,
           case when l_linenumber <= 5 then l_quantity end as some_missing,
           case when l_linenumber <= 6 then l_returnflag end as flag,
           l_extendedprice, l_linestatus
    from lineitem)"""

_COLLINEAR = """collinear as (
    select l_quantity, l_extendedprice, l_extendedprice * (1 - l_discount) as net_price, 7.0::double as constant,
           l_discount, l_discount * 2 + l_tax * 0.01::double as twice_discount, l_tax
    from lineitem)"""


def _union(parts) -> str:
    return "\nunion all\n".join(parts)


def _detect(source: str, target: str, dtype: str, non_numeric: bool = False, ctes: str = "") -> str:
    test = "true" if non_numeric else "false"
    head = f"with {ctes}, " if ctes else "with "
    return f"""{head}p as (
        select count({target}) as n_rows, count(distinct {target}) as unique_count from {source}),
    r as (select *, coalesce(unique_count::double / nullif(n_rows, 0), 0) as ratio from p)
    select '{target}' as target,
        case when {test} or unique_count <= 2 or (unique_count <= 20 and ratio <= 0.05)
             then 'classification' else 'regression' end as problem_type,
        case when {test} or unique_count <= 2 then 'high'
             when unique_count <= 20 and ratio <= 0.05 then 'medium' else 'high' end as confidence,
        case when {test} then '{rules.RULE_TEXT_NON_NUMERIC}'
             when unique_count <= 2 then '{rules.RULE_TEXT_BINARY}'
             when unique_count <= 20 and ratio <= 0.05 then
                 printf('Rule 3: Low cardinality (%d unique values, %s%% ratio)', unique_count, round(ratio * 100, 1)::varchar)
             else printf('Rule 4: High cardinality numeric (%d unique values, %s%% ratio)', unique_count, round(ratio * 100, 1)::varchar)
        end as rule_triggered,
        unique_count, round(ratio, 4) as unique_ratio, '{dtype}' as dtype, n_rows
    from r"""


_LINE_TYPES = [
    ("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
    ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
    ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz"),
]
_NULL_COLUMNS = ["l_orderkey", "l_linenumber", "mostly_missing", "some_missing", "flag", "l_extendedprice", "l_linestatus"]
_VARIED = ["l_quantity", "l_extendedprice", "net_price", "l_discount", "twice_discount", "l_tax"]

_CORR = f"with {_COLLINEAR}, pairs as (" + _union(
    f"select {i} as i, {j} as j, '{a}' as feature_i, '{b}' as feature_j, abs(corr({a}, {b})) as c from collinear"
    for i, a in enumerate(_VARIED) for j, b in enumerate(_VARIED) if i < j) + ")"


def _mi(rows: str, digits: int) -> str:
    """Plug-in mutual information from a CTE ``long(feature, xb, yb)``."""
    return f"""{rows},
    c as (select feature, xb, yb, count(*) as n from long group by all),
    m as (select *, sum(n) over (partition by feature, xb) as nx, sum(n) over (partition by feature, yb) as ny,
                 sum(n) over (partition by feature) as t from c),
    mi as (select feature, greatest(sum(n::double / t * ln(n::double * t / (nx::double * ny))), 0) as s
           from m group by feature)
    select feature, round(s, {digits}) as mutual_info_score from mi"""


def _width(column: str, source: str, bins: int) -> str:
    return (f"least(floor(({column} - (select min({column})::double from {source})) / "
            f"(((select max({column})::double from {source}) - (select min({column})::double from {source})) / {bins})), "
            f"{bins - 1})::int")


_PSI = """psi as (select n, -0.57721566490153286::double + coalesce(sum(1.0::double / (n - 1)) over (
                order by n rows between unbounded preceding and current row), 0) as p
            from (select i as n from range(2, 200001) t(i))),
    all_psi as (select n, p from psi union all select 1, -0.57721566490153286::double)"""

_NEIGHBOUR_MI = f"""with {_DOCS},
    coded as (select doc_id as id, quality as y, n_chars::double as n_chars, odd_share,
                     (dense_rank() over (order by source) - 1)::double as source from docs),
    scale as (select avg(abs(n_chars)) as a, avg(abs(odd_share)) as b, avg(abs(source)) as c from coded),
    v as (select id, y, 'n_chars' as feature, n_chars as x0, a as s from coded, scale union all
          select id, y, 'odd_share', odd_share, b from coded, scale union all
          select id, y, 'source', source, c from coded, scale),
    x as (select id, y, feature, x0 + 1e-10::double * greatest(1.0, s) *
                 (('0x' || substr(md5(id::varchar || '#' || feature), 1, 8))::bigint / 4294967296.0::double) as x from v),
    size as (select y, count(*) as nc from coded group by y),
    d as (select a.feature, a.id, a.y, a.x, abs(a.x - b.x) as d,
                 row_number() over (partition by a.feature, a.id order by abs(a.x - b.x)) as r
          from x a join x b on a.feature = b.feature and a.y = b.y and a.id <> b.id),
    rad as (select feature, id, any_value(y) as y, any_value(x) as x, max(d) as radius, count(*) as k
            from d where r <= 3 group by feature, id),
    m as (select r.feature, r.id, any_value(r.y) as y, any_value(r.k) as k, count(*) as m
          from rad r join x b on r.feature = b.feature
          where abs(b.x - r.x) < r.radius - 8 * 2.220446049250313e-16 * (abs(r.x) + r.radius) group by r.feature, r.id),
    {_PSI}
    select feature, round(greatest(any_value(pn.p) + avg(pk.p) - avg(pc.p) - avg(pm.p), 0), 4) as mutual_info_score
    from m join size s on m.y = s.y
      join all_psi pk on pk.n = m.k join all_psi pc on pc.n = s.nc join all_psi pm on pm.n = m.m
      join (select feature, count(*) as n from m group by feature) t using (feature)
      join all_psi pn on pn.n = t.n
    group by feature"""


def _plane(feature: str) -> str:
    """CTEs of the plane estimate for one feature of part against its price."""
    def axis(column: str) -> str:
        return (f"{column} / s_{column} + 1e-10::double * greatest(1.0, a_{column} / s_{column}) * "
                f"(('0x' || substr(md5(p_partkey::varchar || '#{column}'), 1, 8))::bigint / 4294967296.0::double)")
    facts = ", ".join(f"stddev_pop({c}) as s_{c}, avg(abs({c}))::double as a_{c}" for c in (feature, "p_retailprice"))
    t = feature[2:]
    return f"""facts_{t} as (select {facts} from part),
    pt_{t} as (select p_partkey as id, {axis(feature)} as x, {axis("p_retailprice")} as y from part, facts_{t}),
    rad_{t} as (select id, x, y, d as radius from (select a.id, a.x, a.y, greatest(abs(a.x - b.x), abs(a.y - b.y)) as d,
            row_number() over (partition by a.id order by greatest(abs(a.x - b.x), abs(a.y - b.y))) as r
        from pt_{t} a, pt_{t} b where a.id <> b.id) where r = 3),
    m_{t} as (select '{feature}' as feature, a.id,
            count(*) filter (abs(a.x - b.x) < radius - 8 * 2.220446049250313e-16 * (abs(a.x) + radius)) as mx,
            count(*) filter (abs(a.y - b.y) < radius - 8 * 2.220446049250313e-16 * (abs(a.y) + radius)) as my
        from rad_{t} a, pt_{t} b group by a.id)"""


_PLANE_MI = f"""with {_plane("p_partkey")}, {_plane("p_size")}, {_PSI},
    m as (select * from m_partkey union all select * from m_size)
    select feature, round(greatest((select p from all_psi where n = (select count(*) from part)) + (select p from all_psi where n = 3)
        - avg(px.p) - avg(py.p), 0), 4) as mutual_info_score
    from m join all_psi px on px.n = greatest(mx, 1) join all_psi py on py.n = greatest(my, 1) group by feature"""


def _knn(source: str, key: str, dims: list[str], k: int = 5) -> str:
    """CTE ``near(id, label, r)``: the k nearest rows, ties by key."""
    distance = " + ".join(f"(q.{d} - t.{d}) * (q.{d} - t.{d})" for d in dims)
    return f"""near as (select * from (
        select q.id, t.label, row_number() over (partition by q.id order by {distance}, t.id) as r
        from {source} q, {source} t) where r <= {k})"""


_CODED_DOCS = f"""{_DOCS}, pts as (
    select doc_id as id, n_chars::double as a, (dense_rank() over (order by lang) - 1)::double as b, quality as label
    from docs), {_knn("pts", "id", ["a", "b"])}"""
_PARTS = f"""pts as (select p_partkey as id, p_partkey::double as a, p_size::double as b, p_retailprice as label from part),
    {_knn("pts", "id", ["a", "b"])}"""


def _share(value: str) -> str:
    return f"avg(case when label = {value} then 1.0 else 0.0 end)"


_SHARES = f"""with {_CODED_DOCS},
    votes as (select id, {_share('0')} as p0, {_share('1')} as p1 from near group by id)"""

_RIDGE = """with v as (select p_partkey as id, p_partkey / 1000.0::double as a, p_size::double as b, p_retailprice as y from part),
    mean as (select avg(a) as ma, avg(b) as mb, avg(y) as my from v),
    s as (select sum((a - ma) * (a - ma)) + 1 as aa, sum((b - mb) * (b - mb)) + 1 as bb, sum((a - ma) * (b - mb)) as ab,
                 sum((a - ma) * (y - my)) as ay, sum((b - mb) * (y - my)) as "by" from v, mean),
    w as (select (ay * bb - "by" * ab) / (aa * bb - ab * ab) as wa, ("by" * aa - ay * ab) / (aa * bb - ab * ab) as wb from s),
    model as (select wa, wb, my - wa * ma - wb * mb as w0, ma, mb from w, mean)"""

_RIDGE_SHAP = _RIDGE + """,
    shap as (select avg(abs(wa * (a - ma))) as sa, avg(abs(wb * (b - mb))) as sb from v, model),
    l as (select 0 as o, 'key_k' as feature, sa as s from shap union all select 1, 'size', sb from shap),
    ranked as (select feature, round(s, 6) as mean_abs_shap, row_number() over (order by s desc, o) as rank from l)"""

# --- judged per supplier -------------------------------------------------------

_GUESSES = f"""counted as (
    select l_suppkey, (l_orderkey % 5)::int as fold, (l_quantity > 25)::int as label, l_linenumber as line, count(*) as n
    from lineitem group by all),
  held as (select c.*, h.held_out, c.fold = h.held_out as test from counted c, (select unnest(range(0, 5)) as held_out) h),
  guesses as (
    select l_suppkey, held_out, case when test then 'test' else 'train' end as side, label, n, model_name, ordinal,
           case when wrong then 1 - label else label end as prediction
    from (""" + _union(
    f"select *, '{m}' as model_name, {o} as ordinal, {w} as wrong from held" for m, o, w in [
        (rules.LOGISTIC, 0, "line = 7"), (rules.TREE, 1, "line = 1 and test"), (rules.FOREST, 2, "line <= 3 and test"),
        (rules.BOOSTING, 3, "line = 6 or (line = 5 and test)"), (rules.KNN, 4, "line >= 4")]) + """)),
  f1parts as (
    select l_suppkey, model_name, ordinal, held_out, side, class, sum(actual) as actual, sum(guessed) as guessed, sum(hits) as hits
    from (select l_suppkey, model_name, ordinal, held_out, side, label as class, n as actual, 0 as guessed,
                 case when label = prediction then n else 0 end as hits from guesses
          union all
          select l_suppkey, model_name, ordinal, held_out, side, prediction, 0, n, 0 from guesses)
    group by all),
  by_fold as (
    select l_suppkey, model_name, ordinal, held_out, side, sum(hits)::double / sum(actual) as accuracy,
           avg(2.0::double * hits / (actual + guessed)) as f1_macro
    from f1parts group by all)"""

_ESTIMATES = f"""rows5 as (
    select l_suppkey, (l_orderkey % 5)::int as fold, l_quantity as y, l_linenumber as line, h.held_out,
           (l_orderkey % 5)::int = h.held_out as test
    from lineitem, (select unnest(range(0, 5)) as held_out) h),
  estimates as (""" + _union(
    f"select l_suppkey, held_out, case when test then 'test' else 'train' end as side, y, '{m}' as model_name, "
    f"{o} as ordinal, {p} as p from rows5" for m, o, p in [
        (rules.RIDGE, 0, "y + line - 4"), (rules.TREE, 1, "case when test then y + (line - 4) * 2 else y end"),
        (rules.FOREST, 2, "case when test then y + (line - 4) * 3 else y + line - 4 end"),
        (rules.BOOSTING, 3, "y * 0.75::double + 6"), (rules.KNN, 4, "y + (line - 4) * 8")]) + """),
  by_fold as (
    select l_suppkey, model_name, ordinal, held_out, side,
           1.0 - sum((y - p) * (y - p)) / nullif(var_pop(y) * count(*), 0) as r2, avg(abs(y - p)) as mae
    from estimates group by all)"""


def _summary(head: str, other: str) -> str:
    points = " ".join(f"when '{m}' then {p}" for m, p in rules.INTERPRETABILITY.items())
    sides = ", ".join(
        f"round(avg(case when side = '{s}' then {m} end), 4) as {s}_{m}" for m in (head, other) for s in ("test", "train"))
    return f"""metrics as (
    select *, case model_name {points} end as plain, ((l_suppkey * 7 + ordinal * 11) % 40 + 0.5)::double as seconds
    from (select l_suppkey, model_name, ordinal, {sides},
                 round(greatest(0.0, avg(case when side = 'train' then {head} end) - avg(case when side = 'test' then {head} end)), 4) as overfit_gap
          from by_fold group by all))"""


def _bands(value: str, rows) -> str:
    return "case " + " ".join(f"when {value} <= {upper} then {_lit(result)}" for upper, result in rows) + " end"


def _lit(value) -> str:
    return f"'{value}'" if isinstance(value, str) else f"{value}::double"


def _exact(value: str, digits: int) -> str:
    return f"round(({value})::decimal(38,10), {digits})::double"


def _fixed(value: str, digits: int) -> str:
    return f"printf('%.{digits}f', {_exact(value, digits)})"


def _percent(value: str, digits: int) -> str:
    return f"printf('%.{digits}f%%', {_exact(value + ' * 100', digits)})"


_GAP_PENALTY = _bands("overfit_gap", [(r[0], r[1]) for r in rules.OVERFIT_RULES])
_GAP_LABEL = _bands("overfit_gap", [(r[0], r[2]) for r in rules.OVERFIT_RULES])
_GAP_TEXT = _bands("overfit_gap", [(r[0], r[3]) for r in rules.OVERFIT_RULES])
_SPEED = _bands("seconds", [(r[0], r[1]) for r in rules.SPEED_RULES])
_SPEED_LABEL = _bands("seconds", [(r[0], r[2]) for r in rules.SPEED_RULES])


def _judged(kind: str, only: str = "true") -> str:
    """CTEs ``gated``, ``dims``, ``judged`` for one problem type."""
    w = rules.WEIGHTS[kind]
    gate = ("test_accuracy < 0.5", "DQ1") if kind == rules.CLASSIFICATION else ("test_r2 < 0", "DQ2")
    text = rules.DISQUALIFICATION_TEXT
    if kind == rules.CLASSIFICATION:
        extra = ""
        quality = [
            ("accuracy", "test_accuracy", "null", f"'CV accuracy = ' || {_percent('test_accuracy', 1)}"),
            ("f1_macro", "test_f1_macro", "null",
             f"'Macro F1 = ' || {_percent('test_f1_macro', 1)} || ' (handles class imbalance)'"),
        ]
    else:
        extra = """, min(case when reasons = '' then test_mae end) over (partition by l_suppkey) as low,
                     max(case when reasons = '' then test_mae end) over (partition by l_suppkey) as high"""
        score = "1.0 - (test_mae - low) / (case when high = low then 1.0 else high - low end)"
        quality = [
            ("r2", "greatest(0.0, test_r2)", "null",
             f"'CV R² = ' || {_fixed('test_r2', 4)} || ' (variance explained by model)'"),
            ("mae_score", score, "null",
             f"'Mean Absolute Error = ' || {_fixed('test_mae', 4)} || ' | Normalised score: ' || {_percent('(' + score + ')', 2)}"
             f" || ' (relative to range [' || {_fixed('low', 4)} || ', ' || {_fixed('high', 4)} || '])'"),
        ]
    quality += [
        ("overfit_penalty", f"1.0::double - {_GAP_PENALTY}", _GAP_LABEL, _GAP_TEXT),
        ("speed", _SPEED, _SPEED_LABEL, f"'Training time = ' || {_fixed('seconds', 2)} || 's → ' || {_SPEED_LABEL}"),
        ("interpretability", "plain / 10.0::double", "null",
         "'Hand-designed interpretability score: ' || plain::varchar || '/10'"),
    ]
    dims = _union(
        f"select l_suppkey, model_name, ordinal, {i} as dimension_ordinal, '{title}' as dimension, "
        f"{_exact(score, 4)} as score, {w[title]}::double as weight, "
        f"{_exact(f'({score}) * {w[title]}::double', 5)} as contribution, "
        f"({label})::varchar as label, {explanation} as explanation from ranged where reasons = ''"
        for i, (title, score, label, explanation) in enumerate(quality))
    return f"""gated as (
    select *, concat_ws('; ', case when {gate[0]} then '{text[gate[1]]}' end,
                        case when overfit_gap > 0.25 then '{text["DQ3"]}' end) as reasons
    from metrics where {only}),
  ranged as (select *{extra} from gated),
  dims as ({dims}),
  totals as (select l_suppkey, model_name, round(sum(contribution order by dimension_ordinal), 5) as composite from dims group by all),
  scored as (
    select g.l_suppkey, g.model_name, g.ordinal, g.reasons,
           case when reasons = '' then 'evaluated' else 'disqualified' end as status, coalesce(composite, 0.0) as composite_score
    from gated g left join totals t on g.l_suppkey = t.l_suppkey and g.model_name = t.model_name),
  judged as (
    select *, row_number() over (partition by l_suppkey order by composite_score desc, ordinal) as rank,
           row_number() over (partition by l_suppkey order by (status <> 'evaluated')::int, composite_score desc, ordinal) as place
    from scored)"""


_CLASS = f"with {_GUESSES},\n {_summary('accuracy', 'f1_macro')},\n {_judged(rules.CLASSIFICATION)}"
_REGRESS = f"with {_ESTIMATES},\n {_summary('r2', 'mae')},\n {_judged(rules.REGRESSION)}"
_WEAK = (f"with {_GUESSES},\n {_summary('accuracy', 'f1_macro')},\n "
         + _judged(rules.CLASSIFICATION, f"model_name in ('{rules.FOREST}', '{rules.KNN}')"))

_VERDICT = "case when status <> 'evaluated' then 'DISQUALIFIED' when place = 1 then 'SELECTED' else 'REJECTED' end"
_LEADERBOARD = f"""select l_suppkey, rank, model_name, status, {_VERDICT} as verdict, composite_score,
    reasons as disqualification from judged"""
_WINNERS = """select l_suppkey,
    max(case when place = 1 and status = 'evaluated' then model_name end) as winner,
    max(case when place = 1 and status = 'evaluated' then composite_score end) as winner_score,
    max(case when place = 2 and status = 'evaluated' then model_name end) as runner_up,
    max(case when place = 2 and status = 'evaluated' then composite_score end) as runner_up_score,
    round(max(case when place = 1 and status = 'evaluated' then composite_score end)
        - max(case when place = 2 and status = 'evaluated' then composite_score end), 5) as margin
    from judged group by l_suppkey"""
_DIMENSIONS = "select l_suppkey, model_name, dimension, score, weight, contribution, label, explanation from dims"

_RATIONALES = f""", lines as (
    select l_suppkey, model_name, string_agg('  • ' || dimension || ': ' || {_percent('score', 2)} || ' × ' || weight::varchar
        || ' weight = ' || {_fixed('contribution', 4)} || ' pts — ' || explanation, chr(10) order by dimension_ordinal) as breakdown,
      arg_max(dimension, contribution * 1000 - dimension_ordinal / 1000000.0) as top_dimension,
      arg_max(score, contribution * 1000 - dimension_ordinal / 1000000.0) as top_score
    from dims group by all),
  best as (select l_suppkey, model_name as best_name, composite_score as best_score from judged where place = 1),
  second as (select l_suppkey, model_name as next_name, composite_score as next_score from judged
             where place = 2 and status = 'evaluated')
  select j.l_suppkey, j.model_name, {_VERDICT} as verdict,
    case when status <> 'evaluated' then '{rules.DISQUALIFIED_PREFIX}' || reasons
         when place = 1 then '**' || j.model_name || '** selected with composite score ' || {_fixed('composite_score', 4)} || '.'
            || chr(10) || chr(10) || 'Scoring breakdown:' || chr(10) || breakdown || chr(10)
            || coalesce(chr(10) || 'Runner-up: **' || next_name || '** scored ' || {_fixed('next_score', 4)}
                || ' (margin: ' || {_fixed('(composite_score - next_score)', 4)} || ').', '')
         else '**' || j.model_name || '** scored ' || {_fixed('composite_score', 4)} || ' — '
            || {_fixed('(best_score - composite_score)', 4)} || ' pts behind winner **' || best_name || '** ('
            || {_fixed('best_score', 4)} || '). Strongest dimension: ' || top_dimension || ' (' || {_percent('top_score', 2)}
            || '). Not selected due to lower composite score under the rubric.'
    end as rationale
  from judged j left join lines l on j.l_suppkey = l.l_suppkey and j.model_name = l.model_name
    left join best b on j.l_suppkey = b.l_suppkey left join second s on j.l_suppkey = s.l_suppkey"""

_BLANKED = """blanked as (
    select doc_id, n_chars as raw_n, doc_id % 5 as kind,
           length(regexp_replace(text, '[A-Za-z ]', '', 'g'))::double / length(text) as odd, lang, source as raw_source
    from documents),
  defaults as (select median(n_chars) as mn, median(odd_share) as mo,
                      (select lang from docs group by lang order by count(*) desc, lang limit 1) as ml,
                      (select source from docs where source is not null group by source order by count(*) desc, source limit 1) as ms from docs),
  filled as (
    select doc_id, case when kind in (0, 1) then mn when kind = 2 then 0 else raw_n end::double as n_chars,
           case when kind = 3 then mo else odd end as odd_share, ml as lang,
           case when kind = 1 then ms when kind = 4 then 'src100' else raw_source end as source
    from blanked, defaults)"""

_GAPS = """docs as (
    select doc_id, case when doc_id % 3 <> 0 then n_chars end as n_chars, odd_share, lang,
           case when doc_id % 7 <> 0 then source end as source, quality from whole)"""

_KFOLD = "(('0x' || substr(md5(p_partkey::varchar || '#42'), 1, 15))::bigint % 5)::int"


_WIDE = (
    {c: c for c in _VARIED} | {f"{c}_squared": f"{c} * {c}" for c in _VARIED}
    | {f"{c}_root": f"sqrt(abs({c}))" for c in _VARIED[:3]}
)

ORACLE: dict[str, str] = {
    "csv_roundtrip": "select p_partkey, p_name, p_brand, p_type, p_size::bigint as p_size, p_retailprice from part",
    "json_roundtrip": "select p_partkey, p_name, p_brand, p_type, p_size::bigint as p_size, p_retailprice from part",
    "dataset_profile": "select v.*, (select count(*) from lineitem) as n_rows from (values " + ", ".join(
        f"({i}::bigint, '{c}', '{t}')" for i, (c, t) in enumerate(_LINE_TYPES)) + ') v(ordinal, "column", dtype)',
    "preview_rows": """select p_partkey::varchar as p_partkey, p_name, p_brand, p_type, p_size::varchar as p_size,
        p_retailprice::varchar as p_retailprice from part order by part.p_partkey limit 5""",
    "dataset_info": f"""with {_NULLS} select count(*) as rows, 7::bigint as columns, 'some_missing' as target_column,
        'l_orderkey,l_linenumber,mostly_missing,flag,l_extendedprice,l_linestatus' as original_columns
        from nulls where some_missing is not null""",
    "drop_null_target": f"""with {_NULLS} select l_linestatus, count(*) as n_rows, sum(some_missing) as total
        from nulls where some_missing is not null group by l_linestatus""",
    "select_features": "select p_size, p_type, p_retailprice from part",
    "separate_target": "select p_partkey, p_name, p_brand, p_type, p_size from part",
    "target_profile": """select 'l_discount' as target, 'double' as dtype, count(l_discount) as n_rows,
        count(distinct l_discount) as unique_count, round(count(distinct l_discount)::double / count(l_discount), 6) as unique_ratio
        from lineitem""",
    "target_sample_values": """select row_number() over (order by k) as position, value from (
        select o_orderpriority as value, min(o_orderkey) as k from orders group by 1) order by k limit 5""",
    "detect_binary_numeric": _detect("docs", "quality", "int", ctes=_DOCS),
    "detect_string": _detect("lineitem", "l_returnflag", "string", True),
    "detect_lowcard": _detect("lineitem", "l_linenumber", "int"),
    "detect_regression": _detect("part", "p_retailprice", "double"),
    "class_distribution": """select l_returnflag as label, count(*) as n_rows,
        round(count(*)::double / (select count(*) from lineitem), 4) as share from lineitem group by 1""",
    "target_stats": """select round(avg(value), 4) as mean, round(stddev_samp(value), 4) as std, round(min(value), 4) as min,
        round(max(value), 4) as max, round(skewness(value), 4) as skew from events""",
    "missing_ratio": f"with {_NULLS} " + _union(
        f"select '{c}' as feature, round(avg(case when {c} is null then 1.0 else 0.0 end), 6) as missing_ratio from nulls"
        for c in _NULL_COLUMNS),
    "drop_high_missing": f"with {_NULLS}, r as (" + _union(
        f"select '{c}' as c, avg(case when {c} is null then 1.0 else 0.0 end) as m, count(*) as n_rows from nulls"
        for c in _NULL_COLUMNS) + ') select c as "column", n_rows from r where m <= 0.5',
    "cardinality_filter": "select *, case when n_categories > 20 then 'dropped' else 'kept' end as decision from (" + _union(
        f"select '{c}' as feature, count(distinct {c}) as n_categories from {t}" for t, c in [
            ("documents", "lang"), ("documents", "source"), ("part", "p_name"), ("part", "p_brand"), ("part", "p_type")]) + ")",
    "impute_median": f"""with {_NULLS}, m as (select median(some_missing) as s, median(mostly_missing) as o from nulls)
        select l_linenumber, round(sum(coalesce(some_missing, s)), 4) as some_total,
               round(sum(coalesce(mostly_missing, o)), 4) as mostly_total, count(coalesce(mostly_missing, o)) as n_rows
        from nulls, m group by l_linenumber""",
    "exact_medians": _union(f"select '{c}' as feature, median({c})::double as median from lineitem"
                            for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")),
    "label_encode": f"""with {_NULLS},
        f as (select c, (row_number() over (order by c) - 1)::int as code from (select distinct coalesce(flag, 'nan') as c from nulls)),
        s as (select c, (row_number() over (order by c) - 1)::int as code from (select distinct l_linestatus as c from nulls))
        select flag as flag_text, f.code as flag, s.code as l_linestatus, count(*) as n_rows
        from nulls join f on coalesce(flag, 'nan') = f.c join s on l_linestatus = s.c group by all""",
    "encode_target": """select o_orderpriority, dense_rank() over (order by o_orderpriority) - 1 as code, n_rows
        from (select o_orderpriority, count(*) as n_rows from orders group by 1)""",
    "encode_numeric_target": """select label, row_number() over (order by label) - 1 as code
        from (select distinct p_size::varchar as label from part)""",
    "encode_wide_target": "select c_custkey, dense_rank() over (order by c_name) - 1 as code from customer",
    "cast_target": "select p_partkey, p_size::double as label from part",
    "standard_scale": f"""with {_COLLINEAR}, s as (select avg(l_quantity) as qa, stddev_pop(l_quantity) as qs,
            avg(l_extendedprice) as ea, stddev_pop(l_extendedprice) as es from collinear)
        select l_tax, round(sum((l_quantity - qa) / qs), 4) as l_quantity,
               round(sum((l_extendedprice - ea) / es), 4) as l_extendedprice, round(sum(constant - 7), 4) as constant
        from collinear, s group by l_tax""",
    "prepared_features": """select p_partkey as row_id,
        round((p_partkey - (select avg(p_partkey) from part)) / (select stddev_pop(p_partkey) from part), 6) as p_partkey,
        round((p_size - (select avg(p_size) from part)) / (select stddev_pop(p_size) from part), 6) as p_size,
        (dense_rank() over (order by p_type) - 1)::double as p_type, p_retailprice as label from part""",
    "preparation_params": f"""with {_NULLS}, m as (select median(some_missing) as s from nulls), n as (
            select l_linenumber::double as l_linenumber, coalesce(some_missing, s) as some_missing, l_extendedprice from nulls, m)
        """ + _union(
        f"select '{c}' as feature, 'numeric' as kind, round(median({c}), 4) as median, round(avg({c}), 4) as mean, "
        f"round(stddev_pop({c}), 4) as std, null::varchar as mode from n"
        for c in ("l_linenumber", "some_missing", "l_extendedprice")) + """
        union all select 'flag', 'categorical', null, null, null,
            (select flag from nulls where flag is not null group by flag order by count(*) desc, flag limit 1)""",
    "low_variance": f"with {_COLLINEAR}, v as (" + _union(
        f"select '{c}' as feature, var_samp({c}) as v from collinear"
        for c in (*_VARIED, "constant")) + ") select feature, round(v, 4) as variance, "
        "case when v < 0.001 then 'dropped' else 'kept' end as decision from v",
    "correlation_matrix": _CORR + " select feature_i, feature_j, round(c, 6) as corr from pairs",
    "correlation_matrix_wide": f"with {_COLLINEAR} " + _union(
        f"select '{min(a, b)}' as one, '{max(a, b)}' as other, round(abs(corr({_WIDE[a]}, {_WIDE[b]})), 6) as corr "
        "from collinear" for a, b in combinations(_WIDE, 2)),
    "correlation_prune": _CORR + """ select feature_j as dropped, string_agg(feature_i, ',' order by i) as correlated_with,
        round(max(c), 4) as correlation from pairs where c > 0.9 group by j, feature_j""",
    "feature_report": _CORR + """, v as (""" + _union(
        f"select {i} as ordinal, '{c}' as feature, var_samp({c}) < 0.001 as low from collinear"
        for i, c in enumerate(["l_quantity", "l_extendedprice", "net_price", "constant", "l_discount", "twice_discount", "l_tax"])) + """),
        ok as (select feature from v where not low),
        d as (select distinct feature_j as feature from pairs where c > 0.9 and feature_i in (select feature from ok) and feature_j in (select feature from ok))
        select ordinal::bigint as ordinal, feature, case when low or feature in (select feature from d) then 'removed' else 'selected' end as status,
               case when low then 'low_variance' when feature in (select feature from d) then 'redundant_correlation' end as reason from v""",
    "mi_binned_classification": _mi(f"""with {_DOCS}, coded as (select *, dense_rank() over (order by lang) as lc,
            dense_rank() over (order by source) as sc from docs),
        long as (select 'n_chars' as feature, {_width('n_chars', 'coded', 16)} as xb, quality as yb from coded
            union all select 'odd_share', {_width('odd_share', 'coded', 16)}, quality from coded
            union all select 'lang', lc, quality from coded union all select 'source', sc, quality from coded)""", 5),
    "mi_binned_regression": _mi(f"""with long as (
            select 'p_partkey' as feature, {_width('p_partkey', 'part', 20)} as xb, {_width('p_retailprice', 'part', 20)} as yb from part
            union all select 'p_size', {_width('p_size', 'part', 20)}, {_width('p_retailprice', 'part', 20)} from part)""", 5),
    "mi_neighbour_classification": _NEIGHBOUR_MI,
    "mi_neighbour_regression": _PLANE_MI,
    "feature_ranking": _mi("with long as (" + _union(
        f"select '{c}' as feature, {b} as xb, l_returnflag as yb from lineitem" for c, b in [
            ("l_quantity", _width("l_quantity", "lineitem", 10)), ("l_discount", _width("l_discount", "lineitem", 10)),
            ("l_tax", _width("l_tax", "lineitem", 10)), ("l_linenumber", "l_linenumber"),
            ("l_linestatus", "case when l_linestatus = 'F' then 0 else 1 end")]) + ")", 5).replace(
        "select feature, round(s, 5) as mutual_info_score from mi", """select feature, round(s, 5) as mutual_info_score,
            row_number() over (order by s desc, feature) as rank,
            case when max(s) over () = 0 then 'none' when s / max(s) over () >= 0.66 then 'high'
                 when s / max(s) over () >= 0.33 then 'medium' when s > 0 then 'low' else 'none' end as signal_level from mi"""),
    "stratified_folds": """select o_orderkey, o_orderstatus, ((row_number() over (partition by o_orderstatus
        order by md5(o_orderkey::varchar || '#42'), o_orderkey) - 1) % 5)::int as fold from orders""",
    "kfold": f"select p_partkey, {_KFOLD} as fold from part",
    "ridge_coefficients": _RIDGE + " select round(wa, 6) as key_k, round(wb, 6) as size, round(w0, 6) as intercept from model",
    "knn_classify": f"""with {_CODED_DOCS}, c as (select id, label, count(*) as n from near group by all)
        select id as doc_id, prediction from (select id, label::bigint as prediction,
            row_number() over (partition by id order by n desc, label) as r from c) where r = 1""",
    "knn_regress": f"with {_PARTS} select id as p_partkey, round(avg(label), 6) as prediction from near group by id",
    "cv_metrics_knn": f"""with p as (select p_partkey as id, p_partkey::double as a, p_size::double as b, p_retailprice as label, {_KFOLD} as fold from part),
        near as (select * from (select h.held_out, q.id, any_value(q.label) as y, any_value(q.fold) as fold, list(t.label order by
            (q.a - t.a) * (q.a - t.a) + (q.b - t.b) * (q.b - t.b), t.id)[1:5] as l
            from p q, p t, (select unnest(range(0, 5)) as held_out) h where t.fold <> h.held_out
              and abs(q.a - t.a) <= 60 group by h.held_out, q.id)),
        g as (select held_out, case when fold = held_out then 'test' else 'train' end as side, y, list_sum(l) / 5 as p from near),
        f as (select held_out, side, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) as r2, avg(abs(y - p)) as mae from g group by all),
        s as (select avg(case when side = 'test' then r2 end) as tr, avg(case when side = 'train' then r2 end) as nr,
                     avg(case when side = 'test' then mae end) as tm, avg(case when side = 'train' then mae end) as nm from f)
        select round(tr, 4) as test_r2, round(nr, 4) as train_r2, round(tm, 4) as test_mae, round(nm, 4) as train_mae,
               round(greatest(0.0, nr - tr), 4) as overfit_gap from s""",
    "macro_f1": f"""with {_GUESSES} select l_suppkey, model_name, held_out::int as held_out, side, round(accuracy, 6) as accuracy,
        round(f1_macro, 6) as f1_macro from by_fold""",
    "regression_metrics": f"""with {_ESTIMATES} select l_suppkey, model_name, held_out::int as held_out, side, round(r2, 6) as r2,
        round(mae, 6) as mae from by_fold""",
    "class_metrics_summary": f"""with {_GUESSES}, {_summary('accuracy', 'f1_macro')} select l_suppkey, model_name, test_accuracy,
        train_accuracy, test_f1_macro, train_f1_macro, overfit_gap from metrics""",
    "disqualified": _REGRESS + " select l_suppkey, model_name, reasons from gated",
    "verdict_classification": f"{_CLASS} {_LEADERBOARD}",
    "verdict_regression": f"{_REGRESS} {_LEADERBOARD}",
    "verdict_winners": f"{_CLASS} {_WINNERS}",
    "verdict_no_winner": f"{_WEAK} {_WINNERS}",
    "dimension_scores_classification": f"{_CLASS} {_DIMENSIONS}",
    "dimension_scores_regression": f"{_REGRESS} {_DIMENSIONS}",
    "rationales": f"{_CLASS}{_RATIONALES}",
    "overfit_bands": f"""with {_GUESSES}, {_summary('accuracy', 'f1_macro')} select l_suppkey, model_name,
        case when overfit_gap > 0.1 then 'high' when overfit_gap > 0.05 then 'medium' else 'low' end as band from metrics""",
    "linear_shap": _RIDGE_SHAP + " select feature, mean_abs_shap, rank from ranked",
    "coefficient_importance": _RIDGE + """, l as (select 0 as o, 'key_k' as feature, abs(wa) as s from model
        union all select 1, 'size', abs(wb) from model)
        select feature, round(s, 6) as importance, row_number() over (order by s desc, o) as rank from l""",
    "importance_view": _RIDGE_SHAP + """ select rank, feature, mean_abs_shap as value,
        round(mean_abs_shap * 100 / max(mean_abs_shap) over (), 3) as percent,
        case when mean_abs_shap * 100 / max(mean_abs_shap) over () > 66 then 'high'
             when mean_abs_shap * 100 / max(mean_abs_shap) over () > 33 then 'medium' else 'low' end as signal,
        'SHAP' as source from ranked""",
    "score_fill_defaults": f"with {_DOCS}, {_BLANKED} select doc_id, n_chars, round(odd_share, 6) as odd_share, lang, source from filled",
    "score_encode_unseen": f"""with {_DOCS}, {_BLANKED}, known as (select distinct source as c from docs)
        select doc_id, case when source in (select c from known) then (select count(*) from known where c < source) else -1 end as code_keep,
               (select count(*) from known where c < source) as code_insert from filled""",
    "score_refit": f"""with {_DOCS.replace('docs as', 'whole as')}, {_GAPS}, {_BLANKED},
        grown as (select f.doc_id as id, d.n_chars::double as n_chars, d.odd_share, coalesce(d.source, 'nan') as code, d.source
                  from filled f, docs d union all select doc_id, n_chars, odd_share, source, source from filled),
        mid as (select id, median(n_chars) as mn, median(odd_share) as mo, count(distinct source) as n_source from grown group by id),
        fit as (select id, avg(coalesce(n_chars, mn)) as an, stddev_pop(coalesce(n_chars, mn)) as sn,
                       avg(coalesce(odd_share, mo)) as ao, stddev_pop(coalesce(odd_share, mo)) as so
                from grown join mid using (id) group by id),
        known as (select distinct coalesce(source, 'nan') as c from docs)
        select f.doc_id, round((n_chars - an) / sn, 6) as n_chars, round((odd_share - ao) / so, 6) as odd_share,
               (select count(distinct lang) from docs where lang < f.lang)::double as lang,
               case when n_source > {rules.MAX_CATEGORIES} then 0 else (select count(*) from known where c < f.source) end::double as source
        from filled f join mid on mid.id = f.doc_id join fit on fit.id = f.doc_id""",
    "score_align": "select p_partkey, p_size::double as p_size, 0.0::double as not_there from part",
    "score_linear": _RIDGE + " select id as p_partkey, round(w0 + wa * a + wb * b, 5) as prediction from v, model",
    "class_probabilities_knn": _SHARES + """ select id as doc_id, greatest(p0, p1) as confidence,
        case when greatest(p0, p1) >= 0.75 then 'high' when greatest(p0, p1) >= 0.5 then 'medium' else 'low' end as confidence_band,
        round(p0, 4) as p0, round(p1, 4) as p1, case when p1 > p0 then 'good' else 'poor' end as prediction_label from votes""",
    "score_many_classes": """with o as (select o_orderkey id, o_totalprice::double x, o_custkey::varchar c from orders),
        codes as (select c, row_number() over (order by c) - 1 code from (select distinct c from o)),
        placed as (select *, row_number() over (order by x, id) pos from o),
        near as (select a.id, b.c, row_number() over (partition by a.id order by (a.x - b.x) * (a.x - b.x), b.id) r
                 from placed a join placed b on b.pos between a.pos - 25 and a.pos + 25),
        votes as (select id, code, c, count(*) n from near join codes using (c) where r <= 5 group by id, code, c),
        best as (select *, row_number() over (partition by id order by n desc, code) place, count(*) over (partition by id) classes,
                 sum(n) over (partition by id) total from votes)
        select id o_orderkey, code, c prediction_label, n / total confidence,
               case when n / total >= 0.75 then 'high' when n / total >= 0.5 then 'medium' else 'low' end confidence_band,
               classes::int classes, round(n / total, 4) probability from best where place = 1""",
    "softmax_roles": """select conv_id::varchar || '-' || turn::varchar turn_id,
        (select count(distinct role) from conversations)::int classes, true adds_up, true likeliest
        from conversations where role is not null""",
    "ridge_folds": f"""with v as (select p_partkey / 1000.0::double as a, p_size::double as b, p_retailprice as y, {_KFOLD} as fold from part),
        kept as (select h.left_out, a, b, y from v, (select unnest([0, 1, 2, 3, 4, -1]) as left_out) h where fold <> left_out),
        mean as (select left_out, avg(a) as ma, avg(b) as mb, avg(y) as my from kept group by all),
        s as (select left_out, sum((a - ma) * (a - ma)) + 1 as aa, sum((b - mb) * (b - mb)) + 1 as bb, sum((a - ma) * (b - mb)) as ab,
                     sum((a - ma) * (y - my)) as ay, sum((b - mb) * (y - my)) as "by" from kept join mean using (left_out) group by all),
        w as (select left_out, (ay * bb - "by" * ab) / (aa * bb - ab * ab) as wa, ("by" * aa - ay * ab) / (aa * bb - ab * ab) as wb from s)
        select left_out, round(wa, 6) as key_k, round(wb, 6) as size, round(my - wa * ma - wb * mb, 6) as intercept
        from w join mean using (left_out)""",
    "score_every_model": f"""with f as (select avg(p_size::double) as m, stddev_pop(p_size::double) as s from part),
        v as (select p_partkey, (p_size::double - m) / s as x, p_retailprice as y from part, f),
        mean as (select avg(x) as mx, avg(y) as my from v),
        w as (select sum((x - mx) * (y - my)) / (sum((x - mx) * (x - mx)) + 1) as w from v, mean)
        select p_partkey, model_name, case when model_name = '{rules.RIDGE}' then round(my + w * (x - mx), 5) end as ridge, true as same
        from v, mean, w, (select unnest(['{rules.RIDGE}', '{rules.TREE}', '{rules.FOREST}', '{rules.BOOSTING}', '{rules.KNN}']) as model_name)""",
    "csv_line_breaks": """select doc_id, source, sha256(replace(text, chr(13), '')) "text" from documents""",
    "json_columns": "select o_custkey, o_totalprice, o_orderstatus from orders",
    "first_in_file_order": """select 'row' kind, o_orderpriority || '|' || o_orderstatus || '|' || o_totalprice::varchar as value
        from (select * from orders order by o_orderkey limit 20)
        union all select 'value', row_number() over (order by k) || ' ' || p from (
            select o_orderpriority p, min(o_orderkey) k from orders group by 1) order by 1, 2""",
    "deep_forest": "select 'tree' kind, range id, 0::bigint n from range(100) union all select 'part', p_partkey, 1 from part",
    "tree_shap_adds_up": "select p_partkey row_id, true adds_up from part",
    "sorted_probabilities": _SHARES + """, l as (select id, 'poor' as label, round(p0, 4) as probability from votes
        union all select id, 'good', round(p1, 4) from votes)
        select id as row_id, label, probability, row_number() over (partition by id order by probability desc, label) as position,
               probability = max(probability) over (partition by id) as is_top from l""",
}
