"""Registered queries of formulas as data: texts made from the tables' rows are parsed, checked, compared and put together; SQL says what is to come of each."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .more_queries import FIRST, LAST, load_range, raw_files
from .operators import candidates, combine
from .operators.graph import Lineage, edge_rows, fill_windows
from .operators.registry import CODE, DATE
from .plans import batch
from .plans.compiler import OutOfRange, evaluate
from .plans.ir import Call, Feature
from .queries import CALENDAR, O_, ROWS, query, r5, s5, week_panel
from .sources import features, pools, registry
from .store import fresh_path, write_text

#: Texts of a kind of part, of features f and g and a window w from 0 on; the windows that a formula needs; its canonical
#: text, depth of windows, dates it looks back, and dimension. None where it is no formula.
KINDS: list[tuple[str, tuple[str, str, str, str] | None]] = [
    ("'Abs($' || f || ')'", ("'Abs($' || f || ')'", "0", "0", "1.0")),
    ("'TsMean($' || f || ',' || w || ')'", ("'TsMean($' || f || ',' || w || ')'", "1", "w - 1", "1.0")),
    ("'Ref($' || f || ',' || w || ')'", ("'Ref($' || f || ',' || w || ')'", "1", "w", "1.0")),
    ("'TsStd(TsDelta($' || f || ',2),' || w || ')'", ("'TsStd(TsDelta($' || f || ',2),' || w || ')'", "2", "w + 1", "1.0")),
    ("'TsMax(TsMax(TsMax($' || f || ',2),2),' || w || ')'", None),
    ("' Add( $' || f || ' ,1.0 )'", ("'Add($' || f || ',1.0)'", "0", "0", "1.0")),
    ("'Add(TsVar($' || f || ',' || w || '),$' || g || ')'", ("'Add(TsVar($' || f || ',' || w || '),$' || g || ')'", "1", "w - 1", "NULL")),
    ("'Mul($' || f || ',$' || g || ')'", ("'Mul($' || f || ',$' || g || ')'", "0", "0", "2.0")),
    ("'Abs(' || w || '.5)'", None),
    ("'TsCorr($' || f || ',$' || g || ',' || w || ')'", ("'TsCorr($' || f || ',$' || g || ',' || w || ')'", "1", "w - 1", "0.0")),
    ("'TsMean($' || f || ')'", None),
    ("'No' || f || '($' || f || ')'", None),
    ("'Div($' || f || ',Pow($' || g || ',2.0))'", ("'Div($' || f || ',Pow($' || g || ',2.0))'", "0", "0", "-1.0")),
    ("'Rank($' || f", None),
    ("'Abs($' || f || ') $' || g", None),
    ("'Add($' || f || ',' || w || ')'", None),
    ("'TsCorr($' || f || ',1.0,' || w || ')'", None),
    ("'TsMean($' || f || ',' || w || '.0)'", None),
    ("CAST(w AS VARCHAR)", None),
    ("'Add($' || f || ',-1.5e0)'", ("'Add($' || f || ',-1.5)'", "0", "0", "1.0")),
]
_WINDOWED = [i for i, (_, known) in enumerate(KINDS) if known and "|| w ||" in known[0]]


def _pick(values: list[str]) -> str:
    return f"CASE p_partkey % {len(KINDS)} {' '.join(f'WHEN {i} THEN {v}' for i, v in enumerate(values))} END"


#: id, features, window and text of each part's formula; good if it keeps the rules.
TEXTS = f"""WITH o AS (SELECT p_partkey, 'f' || (p_size % 5) AS f, 'g' || (p_size % 3) AS g, CAST(p_size - 1 AS INTEGER) AS w FROM part),
    t AS (SELECT p_partkey AS id, {_pick([text for text, _ in KINDS])} AS expr, {_pick(["true" if known else "false" for _, known in KINDS])} AND NOT (w = 0 AND p_partkey % {len(KINDS)} IN ({", ".join(map(str, _WINDOWED))})) AS good,
      {_pick([known[0] if known else "NULL" for _, known in KINDS])} AS text, CAST({_pick([known[1] if known else "NULL" for _, known in KINDS])} AS INTEGER) AS depth, CAST({_pick([known[2] if known else "NULL" for _, known in KINDS])} AS INTEGER) AS back,
      CAST({_pick([known[3] if known else "NULL" for _, known in KINDS])} AS DOUBLE) AS dimension FROM o)"""


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p_partkey, f, g and w of each part."""
    own = spark.read.parquet(f"{sf_dir}/part.parquet")
    return own.select("p_partkey", F.concat(F.lit("f"), F.col("p_size") % 5).alias("f"), F.concat(F.lit("g"), F.col("p_size") % 3).alias("g"), (F.col("p_size") - 1).cast("int").alias("w"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and expr: a formula of each part, or something like one."""
    return parts(spark, sf_dir).select(F.col("p_partkey").alias("id"), F.expr(_pick([text for text, _ in KINDS]).replace("AS VARCHAR", "AS STRING")).alias("expr"))


@query(f"{TEXTS} SELECT id, expr FROM t WHERE good")
def valid_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that are formulas and keep the rules, of a text for each part."""
    return candidates.valid(texts(spark, sf_dir))


@query(f"{TEXTS} SELECT id, expr, good FROM t")
def formula_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which texts are formulas: unknown names, missing brackets and windows, constants alone, windows three deep."""
    return batch.described(texts(spark, sf_dir)).select("id", "expr", F.col("text").isNotNull().alias("good"))


@query(f"{TEXTS} SELECT id, text, depth, back, 0 AS ahead, dimension FROM t WHERE good")
def formula_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical text, depth of windows, reach and dimension of each part's formula."""
    return batch.described(texts(spark, sf_dir)).where("text is not null").select("id", "text", "depth", "back", "ahead", "dimension")


@query(f"{TEXTS} SELECT id, CASE WHEN NOT good THEN 'rule' WHEN dimension IS NULL THEN 'unit' ELSE 'reach' END AS problem FROM t WHERE NOT good OR dimension IS NULL OR back > 20")
def refused_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas that a check refuses: rules, unlike dimensions, and windows beyond margins of 20 dates."""
    return batch.described(texts(spark, sf_dir), margins=(20, 3)).where("problem is not null").select("id", "problem")


_SIGNS = {"plus": "close + 1", "minus": "1 - close", "half": "close * vol / 2", "square": "close * close", "negative": "-close", "size": "abs(close - vol)", "over": "2 / close", "power": "pow(2, disc)", "same": "close"}


@query(f"{CALENDAR}, q AS (SELECT date, code, {', '.join(f'{sql} AS {n}' for n, sql in _SIGNS.items())}, lead(close, 2) OVER {O_} AS ahead FROM p WHERE true) SELECT date, code, {', '.join(f'{s5(n)} AS {n}' for n in [*_SIGNS, 'ahead'])} FROM q WHERE plus IS NOT NULL")
def python_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas built with Python's operators, on either side of a number, over weekly sales."""
    c, v, d = Feature("close"), Feature("vol"), Feature("disc")
    made = {"plus": c + 1, "minus": 1 - c, "half": c * v / 2, "square": c**2, "negative": -c, "size": abs(c - v), "over": 2 / c, "power": 2**d, "same": +c, "ahead": Call("Ref", (c,), -2)}
    values = evaluate(week_panel(spark, sf_dir), made).where("plus is not null")
    return values.select(DATE, CODE, *(r5(F.col(n)).alias(n) for n in made))


_PAIRS = [
    ("'Add($' || f || ',$' || g || ')'", "'Add($' || g || ',$' || f || ')'", "0"),
    ("'TsMean($' || f || ',' || (w + 1) || ')'", "'TsMean($' || f || ',' || (w + 2) || ')'", "0"),
    ("'Ref($' || f || ',' || (w + 1) || ')'", "'Ref($' || f || ',' || (w * 7 % 13 + 1) || ')'", "CASE WHEN w = w * 7 % 13 THEN 0 ELSE 1 END"),
    ("'Sub($' || f || ',$' || g || ')'", "'Sub($' || g || ',$' || f || ')'", "2"),
    ("'TsMean($' || f || ',5)'", "'TsStd($' || f || ',5)'", "1"),
    ("'Abs($' || f || ')'", "CASE WHEN w % 2 = 0 THEN '$' || f ELSE '$' || g END", "CASE WHEN w % 2 = 0 THEN 1 ELSE 2 END"),
    ("'Add(Abs($' || f || '),$' || g || ')'", "'Add($' || g || ',$' || f || ')'", "1"),
    ("'Abs($' || f || ')'", "'Abs(1.0)'", "NULL"),
]


def _pair(i: int) -> str:
    return f"CASE p_partkey % {len(_PAIRS)} {' '.join(f'WHEN {k} THEN {p[i]}' for k, p in enumerate(_PAIRS))} END"


@query(f"WITH o AS (SELECT p_partkey, 'f' || (p_size % 5) AS f, 'g' || (p_size % 3) AS g, CAST(p_size - 1 AS INTEGER) AS w FROM part) SELECT p_partkey AS id, {_pair(0)} AS a, {_pair(1)} AS b, CAST({_pair(2)} AS INTEGER) AS distance FROM o")
def formula_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits between two formulas of each part."""
    pairs = parts(spark, sf_dir).select(F.col("p_partkey").alias("id"), F.expr(_pair(0)).alias("a"), F.expr(_pair(1)).alias("b"))
    return batch.distances(pairs)


#: Tokens of a kind of part; what they make, the place of one that is refused, and what may come next.
_TOKENS = [
    ("'$' || f, '' || (w + 1), 'TsMean'", "'TsMean($' || f || ',' || (w + 1) || ')'", "NULL", "'$g 1.0 Abs 5'"),
    ("'$' || f, '2.0', 'Mul'", "'Mul($' || f || ',2.0)'", "NULL", "'$g 1.0 Abs 5'"),
    ("'' || w, '$' || f", "NULL", "0", "NULL"),
    ("'$' || f, '$' || g", "'Add($' || f || ',$' || g || ')'", "NULL", "'$g 1.0 Abs Mul 5'"),
    ("'$' || f, '' || w, '$' || g", "NULL", "2", "NULL"),
    ("'$' || f, '$' || g, '$' || f, '$' || g", "NULL", "NULL", "'$g 1.0 Abs Mul 5'"),
    ("'$' || f, '' || (w + 1)", "NULL", "NULL", "'TsMean'"),
]


def _token(i: int, wrap: str = "{}") -> str:
    return f"CASE p_partkey % {len(_TOKENS)} {' '.join(f'WHEN {k} THEN {wrap.format(t[i])}' for k, t in enumerate(_TOKENS))} END"


@query(f"WITH o AS (SELECT p_partkey, 'f' || (p_size % 5) AS f, 'g' || (p_size % 3) AS g, CAST(p_size - 1 AS INTEGER) AS w FROM part) SELECT p_partkey AS id, {_token(1)} AS text, CAST({_token(2)} AS INTEGER) AS refused_at, {_token(3)} AS allowed FROM o")
def builder_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas put together from tokens of each part: what is refused, what may come next, and parts joined at the end."""
    own = parts(spark, sf_dir).select(F.col("p_partkey").alias("id"), F.expr(_token(0, "array({})")).alias("tokens"))
    return batch.built(own, offered=("$g", "1.0", "Abs", "Mul", "5", "TsMean"), joins=1).drop("tokens")


@query("SELECT 'Abs($' || lower(replace(n_name, ' ', '_')) || ')' AS expression, r_name AS topic, 'number ' || n_nationkey AS description FROM nation JOIN region ON r_regionkey = n_regionkey")
def initial_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas to begin with, one for each nation, from a list in Python's syntax."""
    path = f"{fresh_path(spark, 'initial')}/a.txt"
    own = spark.read.parquet(f"{sf_dir}/nation.parquet").join(spark.read.parquet(f"{sf_dir}/region.parquet"), F.col("n_regionkey") == F.col("r_regionkey")).orderBy("n_nationkey")
    rows = own.select(F.concat(F.lit("Abs($"), F.lower(F.replace("n_name", F.lit(" "), F.lit("_"))), F.lit(")")), "r_name", F.concat(F.lit("number "), "n_nationkey")).collect()  # a small file's lines
    write_text(path, "[" + ",\n ".join(repr(tuple(r)) for r in rows) + "]")
    return spark.createDataFrame(pools.read_initial(path), "expression string, topic string, description string")


@query(
    """WITH y AS (SELECT year(min(o_orderdate)) AS lo, year(max(o_orderdate)) AS hi FROM orders)
    SELECT lower(r_name) AS name, CASE WHEN r_regionkey = 1 THEN '77' ELSE CAST(r_regionkey AS VARCHAR) END AS value FROM region UNION ALL SELECT 'alpha', '0.1'
    UNION ALL SELECT 'keys', '[' || string_agg(n_nationkey, ', ' ORDER BY n_nationkey) || ']' FROM nation UNION ALL SELECT 'names', string_agg(n_name, '+' ORDER BY n_nationkey) FROM nation
    UNION ALL SELECT 'range', '20180101 ' || lo || '1231 ' || (lo + 1) || '0101 ' || hi || '0630' FROM y UNION ALL SELECT 'longest', CAST(2 * count(*) + 2 AS VARCHAR) FROM region
    UNION ALL SELECT 'mode ' || m, CAST(CASE WHEN m = 'other' THEN 0 ELSE w END + r_regionkey AS VARCHAR) FROM region, (VALUES ('local', 252), ('cloud', 378), ('other', 0)) AS v(m, w) WHERE r_regionkey = 3
    UNION ALL SELECT 'problems ' || o_orderpriority, CASE WHEN o_orderpriority LIKE '1%' THEN '4' ELSE '5' END FROM orders GROUP BY 1, 2"""
)
def task_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of a task from the tables: a nested file under what was given, lists from text, checks of descriptions, modes and ranges of dates."""
    regions = {r["r_name"].lower(): r["r_regionkey"] for r in spark.read.parquet(f"{sf_dir}/region.parquet").collect()}  # 5 rows
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").collect()  # 25 rows
    ordered = spark.read.parquet(f"{sf_dir}/orders.parquet")
    lo, hi = ordered.agg(F.year(F.min("o_orderdate")), F.year(F.max("o_orderdate"))).first()
    path = f"{fresh_path(spark, 'task')}/t.json"
    write_text(path, json.dumps({"data": {k: v for k, v in regions.items() if v != 4}, "alpha": 0.1}))
    defaults = dict.fromkeys(regions, 4) | {"alpha": 0.5}
    one = next(k for k, v in regions.items() if v == 1)
    merged = registry.merge({one: 77} | {k: 4 for k, v in regions.items() if v in (2, 4)}, defaults, path)
    rows = [(k, str(v)) for k, v in merged.items()]
    rows += [("keys", str(registry.numbers(", ".join(str(n["n_nationkey"]) for n in nations), int))), ("names", "+".join(registry.numbers(",".join(n["n_name"] for n in nations), str)))]
    rows += [("range", " ".join(registry.date_range("C", lo, hi))), ("longest", str(registry.longest_formula(len(regions))))]
    for mode in ("local", "cloud", "other"):
        try:
            window = combine.settings(mode, alpha=0.5)["window"]
        except ValueError:
            window = 0
        rows.append((f"mode {mode}", str(window + 3)))
    for (priority,) in ordered.select("o_orderpriority").distinct().collect():  # 5 values
        found = registry.problems({"name": priority, "frequency": "weekly", "max_backtrack_days": 1 if priority.startswith("1") else -1})
        rows.append((f"problems {priority}", str(len(found))))
    return spark.createDataFrame(rows, "name string, value string")


_NAMES = "f AS (SELECT '$' || lower(replace(n_name, ' ', '_')) AS f, n_regionkey AS r FROM nation)"


@query(
    f"""WITH {_NAMES}, w(w) AS (VALUES (5), (10), (20), (30))
    SELECT r AS region, 'Abs(' || f || ')' AS expr FROM f UNION ALL SELECT r, 'TsMean(' || f || ',' || w || ')' FROM f, w UNION ALL SELECT a.r, 'Add(' || a.f || ',' || b.f || ')' FROM f AS a JOIN f AS b ON b.r = a.r
    UNION ALL SELECT a.r, 'TsCorr(' || a.f || ',' || b.f || ',' || w || ')' FROM f AS a JOIN f AS b ON b.r = a.r, w UNION ALL SELECT DISTINCT r, 'refused: unknown operator ' || r_name FROM f JOIN region ON r_regionkey = r
    UNION ALL SELECT DISTINCT r, 'different: 20 of 20' FROM f"""
)
def candidate_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each region: every call of some operators on its nations as features, a search space with the region's name as an operator, and random formulas of them, all different."""
    own = spark.read.parquet(f"{sf_dir}/nation.parquet").join(spark.read.parquet(f"{sf_dir}/region.parquet"), F.col("n_regionkey") == F.col("r_regionkey"))
    names = own.groupBy("n_regionkey", "r_name").agg(F.sort_array(F.collect_list(F.lower(F.replace("n_name", F.lit(" "), F.lit("_"))))).alias("names")).collect()  # 5 rows
    rows = []
    for r in names:
        every = candidates.enumerate_calls([Feature(n) for n in r["names"]], ["Abs", "TsMean", "Add", "TsCorr"], (5, 10, 20, 30))
        rows += [(r["n_regionkey"], str(x)) for x in every]
        try:
            candidates.check_search(["Abs", r["r_name"]])
        except ValueError as e:
            rows.append((r["n_regionkey"], f"refused: {e}"))
        drawn = candidates.random_trees(r["names"], 20, seed=r["n_regionkey"])
        rows.append((r["n_regionkey"], f"different: {len(set(map(str, drawn)))} of {len(drawn)}"))
    return spark.createDataFrame(rows, "region int, expr string")


@query(
    """WITH n AS (SELECT n_nationkey, 'TsMean($' || lower(replace(n_name, ' ', '_')) || ',' || (n_regionkey + 2) || ')' AS root, r_name AS topic FROM nation JOIN region ON r_regionkey = n_regionkey),
    c AS (SELECT n.*, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS times FROM n)
    SELECT root AS expression, NULL AS parent, 0 AS depth, 2 AS length, topic, CAST(times + 1 AS INTEGER) AS times, root AS path FROM c
    UNION ALL SELECT 'Abs(' || root || ')', root, 1, 3, topic, 1, 'Abs(' || root || ') < ' || root FROM c
    UNION ALL SELECT 'Add(Abs(' || root || '),$vol)', 'Abs(' || root || ')', 2, 5, 'volume', 1, 'Add(Abs(' || root || '),$vol) < Abs(' || root || ') < ' || root FROM c"""
)
def lineage_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas of each nation, met once more for each of its suppliers, and what was made from them."""
    sold = spark.read.parquet(f"{sf_dir}/supplier.parquet").groupBy("s_nationkey").agg(F.count("*").alias("times"))
    own = spark.read.parquet(f"{sf_dir}/nation.parquet").join(spark.read.parquet(f"{sf_dir}/region.parquet"), F.col("n_regionkey") == F.col("r_regionkey")).join(sold, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    lineage = Lineage()
    for r in own.collect():  # 25 rows
        root = fill_windows(f"TsMean(${r['n_name'].lower().replace(' ', '_')},%d)", (r["n_regionkey"] + 2,))
        for _ in range(1 + (r["times"] or 0)):
            lineage.insert(root, topic=r["r_name"])
        lineage.insert(f"Abs({root})", root, topic=r["r_name"])
        lineage.insert(f"Add(Abs({root}),$vol)", f"Abs({root})", topic="volume")
    paths = spark.createDataFrame([(e, " < ".join(lineage.path(e))) for e in lineage.nodes], "expression string, path string")
    return lineage.to_frame(spark).join(paths, "expression").select("expression", "parent", "depth", "length", "topic", "times", "path")


@query(
    """WITH o AS (SELECT DISTINCT 'f' || (p_size % 5) AS f, 'g' || (p_size % 3) AS g, CAST(p_size AS INTEGER) AS w FROM part), t AS (SELECT *, 'TsMean($' || f || ',' || w || ')' AS m FROM o)
    SELECT DISTINCT 'Add(' || m || ',$' || g || ')' AS parent, m AS child, 'either' AS kind FROM t UNION SELECT 'Add(' || m || ',$' || g || ')', '$' || g, 'either' FROM t UNION SELECT m, '$' || f, 'only' FROM t
    UNION SELECT m, CAST(w AS VARCHAR), 'window' FROM t UNION SELECT 'Sub($' || f || ',$' || g || ')', '$' || f, 'left' FROM t UNION SELECT 'Sub($' || f || ',$' || g || ')', '$' || g, 'right' FROM t"""
)
def formula_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed edges of two formulas of each part."""
    own = parts(spark, sf_dir).select(F.explode(F.array(F.expr("'Add(TsMean($' || f || ',' || (w + 1) || '),$' || g || ')'"), F.expr("'Sub($' || f || ',$' || g || ')'"))).alias("expr"))
    return edge_rows(own).select("parent", "child", "kind").distinct()


@query(f"{ROWS} SELECT 'vol' AS feature, 'vol_raw' AS physical, count(*) AS n, {s5('sum(vol)')} AS total FROM rows_ UNION ALL SELECT 'tax', 'tax_valid', count(*), {s5('sum(tax)')} FROM rows_ UNION ALL SELECT 'absent', NULL, 0, NULL")
def schema_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which column of a file stands for each feature, and how many values and what sum it has."""
    path, _ = raw_files(spark, sf_dir)
    rows = spark.read.parquet(path)
    out = None
    for f in ("vol", "tax", "absent"):
        own = features.physical(f, rows.columns)
        x: Column = F.col(own).cast("double") if own else F.lit(None).cast("double")
        one = rows.agg(F.count(x).alias("n"), r5(F.sum(x)).alias("total")).select(F.lit(f).alias("feature"), F.lit(own).cast("string").alias("physical"), "n", "total")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"{ROWS}, q AS (SELECT year(date) AS y, count(DISTINCT date) AS n FROM rows_ WHERE date BETWEEN DATE '{FIRST}' AND DATE '{LAST}' GROUP BY 1) SELECT CAST(y AS INTEGER) AS year, n, 'TsMean($vol,' || (8 + n) || ')' AS refused FROM q")
def refused_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each year of a loaded range: a window of as many weeks more than the margin before it, which is refused."""
    loaded = load_range(spark, sf_dir)
    weeks = loaded.frame.where("asked").groupBy(F.year(DATE).alias("year")).agg(F.count_distinct(DATE).alias("n")).collect()  # a row for each year
    rows = []
    for r in weeks:
        formula = f"TsMean($vol,{loaded.back + r['n']})"
        try:
            loaded.evaluate({"v": formula})
        except OutOfRange:
            rows.append((r["year"], r["n"], formula))
    return spark.createDataFrame(rows, "year int, n long, refused string")
