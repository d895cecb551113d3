"""SQL text of the registered queries' counterparts.

Least squares with up to three terms is written out by the adjugate of the
covariance matrix; an absent term has variance one and no covariance.
"""

from __future__ import annotations

from itertools import combinations

from roadsky.catalog.views import INCIDENTS_SQL, READINGS_SQL
from roadsky.functions.weather_words import WEATHER_WORDS
from roadsky.schemas import JAM_TARGETS, TRAFFIC_TARGETS, WEATHER_NUMERIC, WEATHER_PREDICTORS

BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
Z975 = 1.959963984540054


def q(name: str) -> str:
    return '"' + name + '"'


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def words_cte(words=WEATHER_WORDS) -> str:
    rows = [
        f"({text(entry)}, {text(rating)}, {priority})"
        for priority, (rating, entries) in enumerate(words.items())
        for entry in entries
    ]
    return f"words(entry, rating, priority) AS (VALUES {', '.join(rows)})"


RATINGS_CTE = f"""
conditions AS (SELECT DISTINCT "Weather_Conditions" AS condition FROM incidents),
ratings AS (
  SELECT condition,
    coalesce((SELECT max(rating) FROM words WHERE entry = trim(condition, {BLANKS})), 'unknown') AS exact_rating,
    coalesce((SELECT arg_min(rating, priority) FROM words WHERE contains(lower(condition), lower(entry))),
             'unknown') AS rating
  FROM conditions
)"""

DURATION = 'seconds / 60 AS "TrafficJamDuration(mins)", seconds / 60 AS "Traffic Jam Duration"'
VALID = "has_end AND seconds > 0 AND seconds <= 86400"

SPEED_EXACT = (
    "CASE lower(\"Congestion_Speed\") WHEN 'fast' THEN 60.0::DOUBLE WHEN 'moderate' THEN 40.0::DOUBLE "
    "WHEN 'slow' THEN 20.0::DOUBLE END"
)


def first_word(column: str, results: dict[str, str], default: str) -> str:
    branches = " ".join(f"WHEN contains({column}, {text(k)}) THEN {v}" for k, v in results.items())
    return f"CASE {branches} ELSE {default} END"


LOWERED = 'lower(trim("Congestion_Speed"))'
SPEED_FOUND = first_word(
    LOWERED, {"fast": "60.0::DOUBLE", "moderate": "40.0::DOUBLE", "slow": "20.0::DOUBLE"}, "NULL"
)
SPEED_FOUND_CATEGORY = first_word(
    LOWERED, {"fast": "'fast'", "moderate": "'moderate'", "slow": "'slow'"}, "'Unknown'"
)
SPEED_CATEGORY = first_word(
    '"Congestion_Speed"', {k: text(k) for k in ("Fast", "Moderate", "Slow")}, "'Unknown'"
)
SPEED_DIGITS = "TRY_CAST(regexp_replace(\"Congestion_Speed\", '[^0-9.]', '', 'g') AS DOUBLE)"

RATED = f"""
rated AS (
  SELECT incidents.*, rating AS weather_rating, exact_rating, {DURATION},
    {SPEED_EXACT} AS "SpeedNumeric", {SPEED_FOUND} AS speed_numeric,
    {SPEED_FOUND_CATEGORY} AS speed_found, {SPEED_CATEGORY} AS speed_category, {SPEED_DIGITS} AS speed_digits,
    CAST(exact_rating = 'good' AS INT) AS "GoodWeather", CAST(exact_rating = 'neutral' AS INT) AS "NeutralWeather",
    CAST(exact_rating = 'bad' AS INT) AS "BadWeather",
    CAST(rating = 'good' AS INT) AS weather_good, CAST(rating = 'bad' AS INT) AS weather_bad,
    CAST(rating = 'neutral' AS INT) AS weather_neutral, CAST(rating = 'unknown' AS INT) AS weather_unknown
  FROM incidents JOIN ratings ON "Weather_Conditions" IS NOT DISTINCT FROM condition
)"""

CLEAN = f"clean AS MATERIALIZED (SELECT * FROM rated WHERE {VALID})"

BASE = f"WITH {INCIDENTS_SQL}, {words_cte()}, {RATINGS_CTE}, {RATED}"
BASE_CLEAN = f"{BASE}, {CLEAN}"
BASE_READINGS = f"WITH {READINGS_SQL}"


def complete(names) -> str:
    return " AND ".join(f"{q(name)} IS NOT NULL" for name in names)


def frame_cte(predictors, targets) -> str:
    """Complete rows of the model columns, all as double."""
    names = list(dict.fromkeys([*predictors, *targets]))
    columns = ", ".join(f"CAST({q(n)} AS DOUBLE) AS {q(n)}" for n in names)
    return f"frame AS (SELECT {columns} FROM clean WHERE {complete(names)})"


def log1p(name: str) -> str:
    return f"CASE WHEN {q(name)} > -1 THEN ln(1 + {q(name)}) END"


# ---- least squares ---------------------------------------------------------

_SHAPE = "model_id, target, predictors, n, my, vy, m1, m2, m3, s11, s12, s13, s22, s23, s33, c1, c2, c3, p"

_SOLVE = """
inverse AS (
  SELECT *, s11 * (s22 * s33 - s23 * s23) - s12 * (s12 * s33 - s13 * s23) + s13 * (s12 * s23 - s13 * s22) AS det
  FROM shape
), slopes AS (
  SELECT *, (s22 * s33 - s23 * s23) / det AS i11, (s13 * s23 - s12 * s33) / det AS i12,
    (s12 * s23 - s13 * s22) / det AS i13, (s11 * s33 - s13 * s13) / det AS i22,
    (s12 * s13 - s11 * s23) / det AS i23, (s11 * s22 - s12 * s12) / det AS i33
  FROM inverse
), fitted AS (
  SELECT *, i11 * c1 + i12 * c2 + i13 * c3 AS b1, i12 * c1 + i22 * c2 + i23 * c3 AS b2,
    i13 * c1 + i23 * c2 + i33 * c3 AS b3
  FROM slopes
), measured AS (
  SELECT *, my - b1 * m1 - b2 * m2 - b3 * m3 AS b0, (b1 * c1 + b2 * c2 + b3 * c3) / vy AS r2,
    n - p - 1 AS v
  FROM fitted
), errors AS (
  SELECT *, n * vy * (1 - r2) / v AS s2,
    %(z)r + (%(z)r ** 3 + %(z)r) / (4 * v) + (5 * %(z)r ** 5 + 16 * %(z)r ** 3 + 3 * %(z)r) / (96 * v * v) AS t975
  FROM measured
), ols AS (
  SELECT *, 1 - (1 - r2) * (n - 1) / v AS adj_r2, sqrt(vy * (1 - r2)) AS rmse,
    CAST(abs(b1) > t975 * sqrt(s2 * i11 / n) AS INT)
      + CAST(p > 1 AND abs(b2) > t975 * sqrt(s2 * i22 / n) AS INT)
      + CAST(p > 2 AND abs(b3) > t975 * sqrt(s2 * i33 / n) AS INT) AS n_sig_predictors,
    CAST(abs(b0) > t975 * sqrt(s2 * (1 + m1 * m1 * i11 + m2 * m2 * i22 + m3 * m3 * i33
      + 2 * (m1 * m2 * i12 + m1 * m3 * i13 + m2 * m3 * i23)) / n) AS INT) AS sig_intercept
  FROM errors
)""" % {"z": Z975}


def model_id(t: int, subset) -> int:
    rank = 0
    for i in subset:
        rank = rank * 1000 + i
    return (t * 10 + len(subset)) * 10**15 + rank


def shared_shape(predictors, labels: dict[str, str], max_predictors: int) -> str:
    """Shape of every model over complete rows: one aggregation per target."""
    xs = [q(name) for name in predictors]
    wide = []
    for t, (target, label) in enumerate(labels.items()):
        matrix = ", ".join(
            "[" + ", ".join(f"covar_pop({a}, {b})" for b in xs) + "]" for a in xs
        )
        wide.append(
            f"SELECT {t} AS t, {text(target)} AS target, count(*) AS n, avg(y) AS my, var_pop(y) AS vy, "
            f"[{', '.join(f'avg({x})' for x in xs)}] AS m, [{matrix}] AS s, "
            f"[{', '.join(f'covar_pop({x}, y)' for x in xs)}] AS c "
            f"FROM (SELECT *, {label} AS y FROM frame) WHERE y IS NOT NULL"
        )
    subsets = [
        (subset + (None,) * (3 - size), size)
        for size in range(1, max_predictors + 1)
        for subset in combinations(range(len(predictors)), size)
    ]
    rows = []
    for (i, j, k), size in subsets:
        subset = [a for a in (i, j, k) if a is not None]
        names = "[" + ", ".join(text(predictors[a]) for a in subset) + "]"
        index = ", ".join("NULL::INT" if a is None else str(a + 1) for a in (i, j, k))
        rows.append(f"({index}, {size}, {model_id(0, subset)}, {names})")
    return f"""
wide AS ({' UNION ALL '.join(wide)}),
subsets(i, j, k, p, rank, predictors) AS (VALUES {', '.join(rows)}),
shape AS (
  SELECT t * 10000000000000000 + rank AS model_id, target, predictors, n, my, vy,
    m[i] AS m1, coalesce(m[j], 0) AS m2, coalesce(m[k], 0) AS m3,
    s[i][i] AS s11, coalesce(s[i][j], 0) AS s12, coalesce(s[i][k], 0) AS s13,
    coalesce(s[j][j], 1) AS s22, coalesce(s[j][k], 0) AS s23, coalesce(s[k][k], 1) AS s33,
    c[i] AS c1, coalesce(c[j], 0) AS c2, coalesce(c[k], 0) AS c3, p
  FROM wide, subsets
)"""


def own_shape(models, source: str = "clean") -> str:
    """Shape of each model over the rows complete for it: one aggregation per model.

    ``models``: (model_id, target, label sql, predictor names, term sqls)
    """
    parts = []
    for number, target, label, names, terms in models:
        x = list(terms) + [None] * (3 - len(terms))

        def cov(a, b, same=False):
            if a is None or b is None:
                return "1.0" if same else "0.0"
            return f"covar_pop({a}, {b})"

        given = [f"x{i + 1}" if term else None for i, term in enumerate(x)]
        columns = ", ".join(f"CAST({term} AS DOUBLE) AS x{i + 1}" for i, term in enumerate(terms))
        present = " AND ".join(f"x{i + 1} IS NOT NULL" for i in range(len(terms)))
        s = {
            f"s{i + 1}{j + 1}": cov(given[i], given[j], i == j) for i in range(3) for j in range(i, 3)
        }
        parts.append(
            f"SELECT {number} AS model_id, {text(target)} AS target, "
            f"[{', '.join(text(n) for n in names)}] AS predictors, count(*) AS n, avg(y) AS my, var_pop(y) AS vy, "
            + ", ".join(f"{'avg(' + g + ')' if g else '0.0'} AS m{i + 1}" for i, g in enumerate(given))
            + ", "
            + ", ".join(f"{sql} AS {name}" for name, sql in s.items())
            + ", "
            + ", ".join(f"{cov(g, 'y')} AS c{i + 1}" for i, g in enumerate(given))
            + f", {len(terms)} AS p FROM (SELECT {label} AS y, {columns} FROM {source}) "
            f"WHERE y IS NOT NULL AND {present}"
        )
    return f"shape AS ({' UNION ALL '.join(parts)})"


def formula(style: str) -> str:
    """SQL of the formula text."""
    if style == "plain":
        return "target || ' ~ ' || array_to_string(predictors, ' + ')"
    if style == "interactions":
        quoted = (
            "array_to_string(list_transform(predictors, lambda x: CASE WHEN regexp_matches(x, '[ ()]') "
            "THEN 'Q(\"' || x || '\")' ELSE x END), ' + ')"
        )
        name = "CASE WHEN regexp_matches(target, '[ ()]') THEN 'Q(\"' || target || '\")' ELSE target END"
        return f"{name} || ' ~ (' || {quoted} || ')**2'"
    return "target || ' ~ (' || array_to_string(predictors, ' + ') || ')'"


MAIN_LABELS = {name: log1p(name) for name in TRAFFIC_TARGETS}

MAIN_SWEEP = (
    f"{BASE_CLEAN}, {frame_cte(WEATHER_PREDICTORS, TRAFFIC_TARGETS)}, "
    f"{shared_shape(WEATHER_PREDICTORS, MAIN_LABELS, 3)}, {_SOLVE}"
)

REVERSED_PREDICTORS = list(reversed(WEATHER_PREDICTORS[:6]))
REVERSED_TARGETS = list(reversed(TRAFFIC_TARGETS))
REVERSED_SWEEP = (
    f"{BASE_CLEAN}, {frame_cte(REVERSED_PREDICTORS, REVERSED_TARGETS)}, "
    f"{shared_shape(REVERSED_PREDICTORS, {n: log1p(n) for n in REVERSED_TARGETS}, 2)}, {_SOLVE}"
)

DUMMIES = ["weather_good", "weather_bad", "weather_neutral", "weather_unknown"]
STANDARD_PREDICTORS = list(reversed(WEATHER_NUMERIC + DUMMIES))
STANDARD_TARGETS = list(reversed(JAM_TARGETS))


def standardised_models():
    for t, target in enumerate(STANDARD_TARGETS):
        for size in (1, 2):
            for subset in combinations(range(len(STANDARD_PREDICTORS)), size):
                names = [STANDARD_PREDICTORS[i] for i in subset]
                names += [n for n in ["Traffic Jam Duration"] if n != target]
                yield model_id(t, subset), target, q(target), names, [q(n) for n in names]


def interaction_models(targets, predictors, max_predictors: int = 2):
    for t, target in enumerate(targets):
        for size in range(1, max_predictors + 1):
            for subset in combinations(range(len(predictors)), size):
                names = [predictors[i] for i in subset]
                terms = [q(n) for n in names]
                if size == 2:
                    terms.append(f"{terms[0]} * {terms[1]}")
                yield model_id(t, subset), target, q(target), names, terms


STANDARD_SWEEP = f"{BASE_CLEAN}, {own_shape(standardised_models())}, {_SOLVE}"


def solve_models(models, source: str = "clean") -> str:
    return f"{BASE_CLEAN}, {own_shape(models, source)}, {_SOLVE}"


CHI2_95 = {1: 3.841458820694124, 2: 5.991464547107979, 3: 7.814727903251179}


def model_rows(models) -> str:
    """``centred``: every row of every model, about the means, beside what was solved."""
    parts = []
    for number, _, label, _, terms in models:
        x = list(terms) + ["0.0"] * (3 - len(terms))
        columns = ", ".join(f"CAST({term} AS DOUBLE) AS x{i + 1}" for i, term in enumerate(x))
        parts.append(f"SELECT {number} AS model_id, CAST({label} AS DOUBLE) AS y, {columns} FROM clean")
    return f"""long AS ({' UNION ALL '.join(parts)}),
centred AS (
  SELECT ols.*, x1 - m1 AS d1, x2 - m2 AS d2, x3 - m3 AS d3, y
  FROM long JOIN ols USING (model_id) WHERE y IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL AND x3 IS NOT NULL
)"""


def robust(models) -> str:
    """Test statistic and HC3 counts: a second look at every row of every model."""
    models = list(models)
    critical = " ".join(f"WHEN {df} THEN {value!r}" for df, value in CHI2_95.items())
    return f"""{solve_models(models)},
{model_rows(models)}, lever AS (
  SELECT *, (y - my - b1 * d1 - b2 * d2 - b3 * d3) ** 2 AS e2,
    (i11 * d1 + i12 * d2 + i13 * d3) / n AS a1, (i12 * d1 + i22 * d2 + i23 * d3) / n AS a2,
    (i13 * d1 + i23 * d2 + i33 * d3) / n AS a3
  FROM centred
), weighted AS (
  SELECT *, e2 / (1 - 1.0 / n - a1 * d1 - a2 * d2 - a3 * d3) ** 2 AS u2,
    1.0 / n - a1 * m1 - a2 * m2 - a3 * m3 AS a0
  FROM lever
), sums AS (
  SELECT model_id, sum(e2) AS e2, var_pop(e2) AS ve, covar_pop(d1, e2) AS g1, covar_pop(d2, e2) AS g2,
    covar_pop(d3, e2) AS g3, sum(u2 * a0 * a0) AS h0, sum(u2 * a1 * a1) AS h1, sum(u2 * a2 * a2) AS h2,
    sum(u2 * a3 * a3) AS h3
  FROM weighted GROUP BY model_id
), tested AS (
  SELECT ols.*, n * (i11 * g1 * g1 + i22 * g2 * g2 + i33 * g3 * g3
      + 2 * (i12 * g1 * g2 + i13 * g1 * g3 + i23 * g2 * g3)) / ve AS bp_stat,
    CAST(abs(b0) > {Z975!r} * sqrt(h0) AS INT) AS robust_intercept,
    CAST(abs(b1) > {Z975!r} * sqrt(h1) AS INT) + CAST(p > 1 AND abs(b2) > {Z975!r} * sqrt(h2) AS INT)
      + CAST(p > 2 AND abs(b3) > {Z975!r} * sqrt(h3) AS INT) AS robust_predictors
  FROM ols JOIN sums USING (model_id)
), judged AS (
  SELECT *, bp_stat > CASE p {critical} END AS heteroskedastic FROM tested
)"""


# ---- models of any width -----------------------------------------------------

CHI2_95_WIDE = {**CHI2_95, 4: 9.487729036781154, 5: 11.070497693516351, 6: 12.591587243743977}


def _cells(width: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(width) for j in range(i + 1)]


def wide_robust(models, width: int, source: str = "clean") -> str:
    """Least squares, test and HC3 of models with up to ``width`` terms, by Cholesky factors told column by column.

    Terms that a model lacks, and terms without spread, are left out: a unit
    row and column stand for them.
    """
    models, places = list(models), range(width)
    long = []
    for number, target, label, names, terms in models:
        x = [*terms, *["0.0"] * (width - len(terms))]
        columns = ", ".join(f"CAST({term} AS DOUBLE) AS x{i}" for i, term in enumerate(x))
        long.append(
            f"SELECT {number} AS model_id, {text(target)} AS target, [{', '.join(text(n) for n in names)}] AS predictors, "
            f"{len(terms)} AS p, CAST({label} AS DOUBLE) AS y, {columns} FROM {source}"
        )
    steps, above = [], "shape"

    def step(columns: str) -> None:
        nonlocal above
        name = f"step{len(steps)}"
        steps.append(f"{name} AS MATERIALIZED (SELECT *, {columns} FROM {above})")
        above = name

    # L L' = S
    for j in places:
        square = f"s{j}{j}" + "".join(f" - l{j}{k} * l{j}{k}" for k in range(j))
        step(f"sqrt({square}) AS l{j}{j}")
        below = [f"(s{i}{j}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j)) + f") / l{j}{j} AS l{i}{j}" for i in range(j + 1, width)]
        if below:
            step(", ".join(below))
    # the inverse of L, row by row
    for i in places:
        step(
            ", ".join(
                f"1 / l{i}{i} AS v{i}{i}" if i == j else "-(" + " + ".join(f"l{i}{k} * v{k}{j}" for k in range(j, i)) + f") / l{i}{i} AS v{i}{j}"
                for j in range(i + 1)
            )
        )
    step(", ".join(f"{' + '.join(f'v{k}{i} * v{k}{j}' for k in range(max(i, j), width))} AS i{i}{j}" for i in places for j in places))
    step(", ".join(f"{' + '.join(f'i{i}{j} * c{j}' for j in places)} AS b{i}" for i in places))
    both = [(i, j) for i in places for j in places]
    explained = " + ".join(f"b{i} * c{i}" for i in places)
    corner = " + ".join(f"m{i} * m{j} * i{i}{j}" for i, j in both)
    step(f"my - ({' + '.join(f'b{i} * m{i}' for i in places)}) AS b, ({explained}) / vy AS r2, n - rank - 1 AS v, {corner} AS corner")
    z = Z975
    step(
        f"n * vy * (1 - r2) / v AS s2, {z!r} + {(z**3 + z) / 4!r} / v + {(5 * z**5 + 16 * z**3 + 3 * z) / 96!r} / (v * v) AS t975, "
        "1 - (1 - r2) * (n - 1) / v AS adj_r2"
    )
    plain = " + ".join(f"CAST(u{i} AND abs(b{i}) > t975 * sqrt(s2 * i{i}{i} / n) AS INT)" for i in places)
    step(f"{plain} AS n_sig_predictors, CAST(abs(b) > t975 * sqrt(s2 * (1 + corner) / n) AS INT) AS sig_intercept")
    solved = above
    lever = ", ".join(f"({' + '.join(f'i{i}{j} * d{j}' for j in places)}) / n AS a{i}" for i in places)
    critical = " ".join(f"WHEN {k} THEN {v!r}" for k, v in CHI2_95_WIDE.items())
    gathered = " + ".join(f"i{i}{j} * g{i} * g{j}" for i, j in both)
    robust = " + ".join(f"CAST(u{i} AND abs(b{i}) > {z!r} * sqrt(h{i}) AS INT)" for i in places)
    # left out: the unit rows keep their place, but have no slope and no influence
    return f"""{BASE_CLEAN},
long AS ({' UNION ALL '.join(long)}),
whole AS (SELECT * FROM long WHERE y IS NOT NULL AND {' AND '.join(f'x{i} IS NOT NULL' for i in places)}),
raw AS (
  SELECT model_id, target, predictors, p, count(*) AS n, avg(y) AS my, var_pop(y) AS vy,
    {', '.join(f'avg(x{i}) AS m{i}, covar_pop(x{i}, y) AS c{i}, var_pop(x{i}) > 0 AS u{i}' for i in places)},
    {', '.join(f'covar_pop(x{i}, x{j}) AS r{i}{j}' for i, j in _cells(width))}
  FROM whole GROUP BY ALL
), shape AS (
  SELECT *, {', '.join(f'CASE WHEN u{i} THEN r{i}{i} ELSE 1 END AS s{i}{i}' if i == j else f'r{i}{j} AS s{i}{j}' for i, j in _cells(width))},
    {' + '.join(f'CAST(u{i} AS INT)' for i in places)} AS rank
  FROM raw
), {', '.join(steps)},
centred AS (
  SELECT s.*, {', '.join(f'x{i} - m{i} AS d{i}' for i in places)}, y FROM whole w JOIN {solved} s USING (model_id)
), lever AS (
  SELECT *, (y - my - {' - '.join(f'b{i} * d{i}' for i in places)}) ** 2 AS e2, {lever} FROM centred
), weighted AS (
  SELECT *, e2 / (1 - 1.0 / n - {' - '.join(f'a{i} * d{i}' for i in places)}) ** 2 AS weight,
    1.0 / n - {' - '.join(f'a{i} * m{i}' for i in places)} AS a
  FROM lever
), sums AS (
  SELECT model_id, var_pop(e2) AS ve, sum(weight * a * a) AS h,
    {', '.join(f'covar_pop(d{i}, e2) AS g{i}, sum(weight * a{i} * a{i}) AS h{i}' for i in places)}
  FROM weighted GROUP BY model_id
), judged AS (
  SELECT *, bp_stat > CASE p {critical} END AS heteroskedastic FROM (
    SELECT s.*, n * ({gathered}) / ve AS bp_stat, CAST(abs(b) > {z!r} * sqrt(h) AS INT) AS robust_intercept,
      {robust} AS robust_predictors
    FROM {solved} s JOIN sums USING (model_id))
)"""


def product_models(targets, predictors, max_predictors: int):
    """Main effects and all products of pairs, for any number of predictors."""
    for t, target in enumerate(targets):
        for size in range(1, max_predictors + 1):
            for subset in combinations(range(len(predictors)), size):
                names = [predictors[i] for i in subset]
                terms = [q(n) for n in names]
                yield model_id(t, subset), target, q(target), names, terms + [f"{a} * {b}" for a, b in combinations(terms, 2)]
