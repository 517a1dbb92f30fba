"""SQL that says, for another engine, what each registered query must return."""

from __future__ import annotations

from declarium.operators.insights import LIMITATIONS
from declarium.plans.registry import CATEGORIES, END, HORIZON, LAST_ROW, REGION, START, YEAR
from declarium.plans.tables import BROKEN_TITLE, COPIES, RAW
from declarium.schema import (
    CATEGORY_LIMITATION,
    CATEGORY_METHOD,
    LIMITED,
    MODERATE,
    MONTH_NAMES,
    NO_HISTORY,
    REGION_AREAS,
    REGION_NAMES,
    REGION_WIDE,
    REGRESSION_MODEL,
    SEASONAL_MODEL,
    SEASONS,
    STRONG,
)

FLOOR = "DATE '2001-08-01'"
FIRST_FORECAST = "DATE '2001-09-01'"
MONTHS = "[" + ", ".join(f"'{name}'" for name in MONTH_NAMES) + "]"
PLACES = """orders JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


def rounded(expression: str, digits: int = 6) -> str:
    value = f"round({expression}, {digits})"
    return f"CASE WHEN {value} = 0 THEN 0.0::DOUBLE ELSE {value} END"


def month(expression: str) -> str:
    return f"CAST(date_trunc('month', {expression}) AS DATE)"


def quoted(texts: list[str]) -> str:
    return ", ".join(f"'{text}'" for text in texts)


RECORDS = f"""records AS (
    SELECT o_orderkey AS id, o_custkey AS entity, o_orderdate AS recorded_at,
        o_orderpriority AS category, o_orderstatus AS type_code,
        CASE o_orderstatus WHEN 'F' THEN 'Filled' WHEN 'O' THEN 'Open'
            ELSE o_orderstatus END AS type_label,
        n_name AS geo, 'Region ' || (r_regionkey + 1) AS grp,
        r_regionkey + 1 AS region_number, c_mktsegment AS area
    FROM {PLACES})"""
IN_RANGE = f"recorded_at >= DATE '{START}' AND recorded_at < DATE '{END}' + 1"
SELECTED = f"""{RECORDS}, selected AS (
    SELECT * FROM records WHERE {IN_RANGE} AND grp = '{REGION}')"""
SEASON = "CASE " + " ".join(
    f"WHEN month IN ({', '.join(map(str, months))}) THEN '{name}'"
    for name, months in SEASONS.items()
) + " END"
SEASON_ORDER = "CASE " + " ".join(
    f"WHEN month IN ({', '.join(map(str, months))}) THEN {position}"
    for position, months in enumerate(SEASONS.values())
) + " END"
SEASONALITY = f"""{SELECTED}, months AS (
    SELECT CAST(m AS INTEGER) AS month, {MONTHS}[m] AS name,
        (SELECT count(*) FROM selected WHERE month(recorded_at) = m) AS declaration_records
    FROM generate_series(1, 12) AS g(m))"""


def top(source: str, key: str, limit: int, with_: str = RECORDS) -> str:
    return f"""WITH {with_} SELECT {key} AS name, count(*) AS declaration_records
    FROM {source} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {limit}"""


# --- cleaning ---

RAW_TABLE = "raw AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in RAW.items()) + f" FROM {PLACES})"
CASED = r"\p{Lu}\p{Ll}\p{Lt}"


def clean(expression: str) -> str:
    stripped = f"trim({expression}, chr(9) || chr(10) || chr(13) || ' ')"
    return f"CASE WHEN {stripped} NOT IN ('', 'nan', 'NaN', 'None', '<NA>') THEN {stripped} END"


def title(expression: str) -> str:
    return f"""array_to_string(list_transform(
        regexp_extract_all({expression}, '[{CASED}]+|[^{CASED}]+'),
        lambda run: CASE run[1] WHEN 'ß' THEN 'Ss' ELSE upper(run[1]) END
            || lower(run[2:])), '')"""


def whole(expression: str) -> str:
    number = f"TRY_CAST({expression} AS DOUBLE)"
    return f"CASE WHEN {number} = floor({number}) THEN CAST({number} AS INTEGER) END"


def parsed(expression: str) -> str:
    return f"TRY_CAST(replace({expression}, 'Z', '') AS TIMESTAMP)"


REGION_LABEL = "coalesce('Region ' || region, 'Not Reported')"
TYPED = f"""{RAW_TABLE}, typed AS (
    SELECT id, {whole('disasterNumber')} AS disasterNumber,
        upper({clean('state')}) AS state,
        upper({clean('declarationType')}) AS declarationType,
        {parsed('declarationDate')} AS declarationDate,
        {title(clean('incidentType'))} AS incidentType,
        {clean('declarationTitle')} AS declarationTitle,
        {title(clean('designatedArea'))} AS designatedArea,
        {whole('region')} AS region,
        {clean('designatedIncidentTypes')} AS designatedIncidentTypes,
        {parsed('lastRefresh')} AS lastRefresh
    FROM raw)"""
DATE_PARTS = f"""CAST(year(declarationDate) AS INTEGER) AS declarationYear,
    CAST(month(declarationDate) AS INTEGER) AS declarationMonth,
    {MONTHS}[month(declarationDate)] AS declarationMonthName,
    CAST(quarter(declarationDate) AS INTEGER) AS declarationQuarter,
    strftime(declarationDate, '%Y-%m') AS declarationMonthYear"""



def normalised(source: str) -> str:
    """Columns of the normalised table, over typed columns."""
    return f"""SELECT id, disasterNumber, coalesce(state, 'Not Reported') AS state, declarationType,
            CASE declarationType WHEN 'DR' THEN 'Major Disaster' WHEN 'EM' THEN 'Emergency'
                WHEN 'FM' THEN 'Fire Management Assistance'
                ELSE coalesce(declarationType, 'Not Reported') END AS declarationTypeLabel,
            declarationDate, {DATE_PARTS},
            coalesce(incidentType, 'Not Reported') AS incidentType,
            coalesce(declarationTitle, 'Not Reported') AS declarationTitle,
            coalesce(designatedArea, 'Not Reported') AS designatedArea,
            region, {REGION_LABEL} AS femaRegion, designatedIncidentTypes, lastRefresh
        FROM {source}"""


DIRTY = "dirty AS (" + " UNION ALL ".join(
    "SELECT " + ", ".join(f"{changed.get(c, c)} AS {c}" for c in RAW) + f" FROM raw WHERE {kept}"
    for changed, kept in COPIES
) + ")"
TYPED_DIRTY = TYPED.replace(RAW_TABLE, f"{RAW_TABLE}, {DIRTY}").replace("FROM raw)", "FROM dirty)")
TIDY = f"""{TYPED_DIRTY}, tidy AS (
    SELECT * FROM ({normalised('typed')})
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY {", ".join(
        f"{name} DESC NULLS LAST" for name in LAST_ROW)}) = 1)"""

# --- star schema ---

STAR_RECORDS = f"""{RECORDS}, star AS (
    SELECT * REPLACE (nullif(area, 'BUILDING') AS area), nullif(type_code, 'P') AS codes
    FROM records),
location AS (
    SELECT row_number() OVER (ORDER BY geo NULLS FIRST, grp NULLS FIRST,
        region_number NULLS FIRST, area NULLS FIRST) AS locationKey, *
    FROM (SELECT DISTINCT geo, grp, region_number, area FROM star)),
kind AS (
    SELECT row_number() OVER (ORDER BY category NULLS FIRST, codes NULLS FIRST)
        AS incidentTypeKey, *
    FROM (SELECT DISTINCT category, codes FROM star)),
fact AS (
    SELECT id, entity, type_label,
        CAST(strftime(recorded_at, '%Y%m%d') AS INTEGER) AS dateKey,
        locationKey, incidentTypeKey
    FROM star LEFT JOIN location ON star.geo IS NOT DISTINCT FROM location.geo
        AND star.grp IS NOT DISTINCT FROM location.grp
        AND star.region_number IS NOT DISTINCT FROM location.region_number
        AND star.area IS NOT DISTINCT FROM location.area
    LEFT JOIN kind ON star.category IS NOT DISTINCT FROM kind.category
        AND star.codes IS NOT DISTINCT FROM kind.codes),
days AS (
    SELECT DISTINCT CAST(strftime(recorded_at, '%Y%m%d') AS INTEGER) AS dateKey,
        CAST(recorded_at AS DATE) AS fullDate, CAST(year(recorded_at) AS INTEGER) AS year,
        CAST(month(recorded_at) AS INTEGER) AS month, {MONTHS}[month(recorded_at)] AS monthName,
        CAST(quarter(recorded_at) AS INTEGER) AS quarter,
        strftime(recorded_at, '%Y-%m') AS monthYear
    FROM records WHERE recorded_at IS NOT NULL)"""

# --- insights ---

YEARLY = f"""yearly AS (
    SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders GROUP BY 1)"""
USED = f"""used AS (
    SELECT * FROM yearly WHERE year < {YEAR}
        OR (SELECT count(*) FROM yearly WHERE year < {YEAR}) < 4)"""


def trend_sql(used: str, digits) -> str:
    return f"""WITH {YEARLY}, {used}, ranked AS (
        SELECT n, row_number() OVER (ORDER BY year DESC) AS back, count(*) OVER () AS years
        FROM used),
    split AS (
        SELECT *, least(10, greatest(2, years // 2)) AS w FROM ranked),
    parts AS (
        SELECT n, CASE WHEN years <= w THEN back <= years - greatest(1, years // 2)
                ELSE back <= w END AS recent,
            CASE WHEN years <= w THEN back > years - greatest(1, years // 2)
                ELSE back > w AND back <= 2 * w END AS prior
        FROM split),
    averages AS (
        SELECT coalesce(avg(n) FILTER (WHERE prior), 0.0) AS p,
            coalesce(avg(n) FILTER (WHERE recent), 0.0) AS r,
            CAST(count(*) FILTER (WHERE recent) AS INTEGER) AS recent_years
        FROM parts),
    changed AS (
        SELECT *, CASE WHEN p > 0 THEN (r - p) / p * 100 ELSE 0.0 END AS c FROM averages),
    named AS (
        SELECT *, CASE WHEN c > 5 THEN 'increasing' WHEN c < -5 THEN 'decreasing'
            ELSE 'relatively stable' END AS direction
        FROM changed)
    SELECT direction, {digits('p')} AS prior_average, {digits('r')} AS recent_average,
        {digits('c')} AS percent_change, recent_years,
        CASE WHEN c > 5 THEN printf('Yearly records grew by %.1f%% from the earlier years to the '
            || 'last %d complete ones: the long-term tendency is upwards.',
            round_even(abs(c), 1), recent_years)
        ELSE 'Over the long term, yearly records are ' || direction || '.'
        END AS interpretation
    FROM named"""


# --- series and models ---


def series_sql(group: str) -> str:
    """CTEs from the records to the gapless monthly series of every group."""
    return f"""{RECORDS},
monthly AS (
    SELECT {group} AS region, {month('recorded_at')} AS month, count(*) AS n
    FROM records WHERE recorded_at < {FLOOR} GROUP BY 1, 2),
bounds AS (SELECT region, min(month) AS first, max(month) AS last FROM monthly GROUP BY 1),
spine AS (
    SELECT region, first, last, CAST(unnest(generate_series(
        CAST(first AS TIMESTAMP), CAST(last AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS month
    FROM bounds),
series AS (
    SELECT region, month, coalesce(n, 0) AS n,
        CAST(datediff('month', first, month) AS INTEGER) AS position,
        CAST(datediff('month', first, last) + 1 AS INTEGER) AS months
    FROM spine LEFT JOIN monthly USING (region, month))"""


FITS = """fits AS (
    SELECT region, month, n, 'full' AS fit, months - position AS rank, months AS size,
        position - (months - least(months, 180)) AS off
    FROM series
    UNION ALL
    SELECT region, month, n, 'backtest', months - position - 12, least(months, 180) - 12,
        position - (months - least(months, 180))
    FROM series
    WHERE least(months, 180) >= 48 AND months - position > 12 AND months - position <= 180)"""


def features(offset: str, month_number: str) -> list[str]:
    result = ["1.0::DOUBLE", f"{offset} / 12.0::DOUBLE"]
    for harmonic in (1, 2, 3):
        angle = f"2 * pi() * {harmonic} * ({month_number} - 1) / 12"
        result += [f"sin({angle})", f"cos({angle})"]
    return result


PAIRS = [(i, j) for i in range(8) for j in range(i, 8)]
SUMS = (
    """prepared AS (
    SELECT region, fit, CAST(month - to_months(CAST(off AS INTEGER)) AS DATE) AS origin,
        power(0.5::DOUBLE, (rank - 1) / 36.0::DOUBLE) AS w, ln(1.0::DOUBLE + n) AS y, """
    + ", ".join(f"{e} AS x{i}" for i, e in enumerate(features("off", "month(month)")))
    + """
    FROM fits WHERE rank <= 180),
sums AS (
    SELECT region, fit, min(origin) AS origin, count(*) AS training_months, """
    + ", ".join(f"sum(w * x{i} * x{j}) AS xx_{i}_{j}" for i, j in PAIRS)
    + ", "
    + ", ".join(f"sum(w * x{i} * y) AS xy_{i}" for i in range(8))
    + """
    FROM prepared GROUP BY 1, 2)"""
)


def elimination() -> str:
    """Solving the 8 × 8 system column by column, one CTE per step."""
    entries = ", ".join(
        f"xx_{i}_{j}{' + 0.12' if i == j and i else ''} AS a_{i}_{j}" for i, j in PAIRS
    ) + ", " + ", ".join(f"xy_{i} AS b_{i}" for i in range(8))
    steps = [f"e0 AS (SELECT region, fit, origin, {entries} FROM sums)"]
    for k in range(7):
        entries = ", ".join(
            [f"a_{i}_{j}" for i, j in PAIRS if i <= k]
            + [f"a_{i}_{j} - a_{k}_{i} / a_{k}_{k} * a_{k}_{j} AS a_{i}_{j}"
               for i, j in PAIRS if i > k]
            + [f"b_{i}" for i in range(k + 1)]
            + [f"b_{i} - a_{k}_{i} / a_{k}_{k} * b_{k} AS b_{i}" for i in range(k + 1, 8)]
        )
        steps.append(f"e{k + 1} AS (SELECT region, fit, origin, {entries} FROM e{k})")
    source = "e7"
    for i in reversed(range(8)):
        rest = "".join(f" - a_{i}_{j} * c{j}" for j in range(i + 1, 8))
        steps.append(f"s{i} AS (SELECT *, (b_{i}{rest}) / a_{i}_{i} AS c{i} FROM {source})")
        source = f"s{i}"
    return ",\n".join(steps)


SEASONAL = """same_month AS (
    SELECT region, fit, month(month) AS moy, n,
        row_number() OVER (PARTITION BY region, fit, month(month) ORDER BY month DESC) AS nth
    FROM fits),
counted AS (
    SELECT *, count(*) OVER (PARTITION BY region, fit, moy) AS k FROM same_month WHERE nth <= 5),
profile AS (
    SELECT region, fit, moy, sum(n * (k + 1 - nth)) / CAST(sum(k + 1 - nth) AS DOUBLE) AS base
    FROM counted GROUP BY 1, 2, 3),
years AS (
    SELECT region, fit, CAST(max(size) AS INTEGER) AS size,
        avg(n) FILTER (WHERE rank <= 12) AS recent_mean,
        avg(n) FILTER (WHERE rank > 12 AND rank <= 24) AS previous_mean
    FROM fits GROUP BY 1, 2),
levels AS (
    SELECT *, CASE WHEN size >= 24 AND previous_mean > 0
        THEN least(greatest(recent_mean / previous_mean, 0.65::DOUBLE), 1.35::DOUBLE)
        ELSE 1.0::DOUBLE END AS level
    FROM years)"""


def predictions_sql(horizon: int) -> str:
    terms = features("datediff('month', origin, t.month)", "month(t.month)")
    dot = " + ".join(f"c{i} * ({e})" for i, e in enumerate(terms))
    return f"""{FITS}, {SUMS}, {elimination()}, {SEASONAL},
targets AS (
    SELECT region, 'backtest' AS fit, month, 0 AS step, n FROM series
    WHERE least(months, 180) >= 48 AND months - position <= 12
    UNION ALL
    SELECT region, 'full', month, 0, n FROM series WHERE months - position <= 180
    UNION ALL
    SELECT region, 'full', CAST({FIRST_FORECAST} + to_months(CAST(h - 1 AS INTEGER)) AS DATE), h, NULL
    FROM bounds, generate_series(1, {horizon}) AS g(h)),
predicted AS (
    SELECT t.region, t.fit, t.month, t.step, t.n,
        greatest(0.0::DOUBLE, exp({dot}) - 1) AS regression,
        greatest(0.0::DOUBLE, coalesce(base, recent_mean) * level) AS seasonal
    FROM targets t JOIN s0 USING (region, fit) JOIN levels l USING (region, fit)
        LEFT JOIN profile p ON p.region = t.region AND p.fit = t.fit AND p.moy = month(t.month)),
errors AS (
    SELECT region, avg(abs(n - regression)) FILTER (WHERE fit = 'backtest') AS regression_mae,
        avg(abs(n - seasonal)) FILTER (WHERE fit = 'backtest') AS seasonal_mae
    FROM predicted GROUP BY 1),
chosen AS (
    SELECT *, CASE WHEN seasonal_mae < regression_mae THEN '{SEASONAL_MODEL}'
            ELSE '{REGRESSION_MODEL}' END AS model,
        CASE WHEN seasonal_mae < regression_mae THEN seasonal_mae ELSE regression_mae END
            AS validation_mae
    FROM errors),
lagged AS (
    SELECT a.region, a.month, a.n - b.n AS residual
    FROM series a JOIN series b ON a.region = b.region AND b.position = a.position - 12
    WHERE a.months - a.position <= least(a.months, 180) - 12)"""


def scale_sql(residuals: str) -> str:
    return f"""residuals AS ({residuals}),
centres AS (SELECT region, median(residual) AS centre FROM residuals GROUP BY 1),
scales AS (
    SELECT region, greatest(1.0::DOUBLE, median(abs(residual - centre)) * 1.4826::DOUBLE,
        sqrt(avg(residual * residual)) * 0.65::DOUBLE) AS scale
    FROM residuals JOIN centres USING (region) GROUP BY 1)"""


def volumes_sql(horizon: int) -> str:
    chosen_residuals = f"""
    SELECT region, CAST(residual AS DOUBLE) AS residual FROM lagged JOIN chosen USING (region)
    WHERE model = '{SEASONAL_MODEL}'
    UNION ALL
    SELECT p.region, n - regression FROM predicted p JOIN chosen c USING (region)
    WHERE fit = 'full' AND step = 0 AND model = '{REGRESSION_MODEL}'"""
    return f"""{predictions_sql(horizon)}, {scale_sql(chosen_residuals)},
estimated AS (
    SELECT p.region, p.month, CAST(step AS INTEGER) AS step,
        CASE WHEN model = '{SEASONAL_MODEL}' THEN seasonal ELSE regression END AS estimate,
        scale * 1.28::DOUBLE * sqrt(1 + step / 12.0::DOUBLE) AS uncertainty, model, validation_mae,
        last AS trained_through
    FROM predicted p JOIN chosen USING (region) JOIN scales USING (region)
        JOIN bounds USING (region)
    WHERE step > 0),
volumes AS (
    SELECT region, month, step,
        CAST(round_even(greatest(0.0::DOUBLE, estimate), 0) AS BIGINT) AS declarationRecords,
        CAST(round_even(greatest(0.0::DOUBLE, estimate - uncertainty), 0) AS BIGINT)
            AS lowerEstimate,
        CAST(round_even(greatest(0.0::DOUBLE, estimate + uncertainty), 0) AS BIGINT)
            AS upperEstimate,
        model, validation_mae, trained_through
    FROM estimated)"""


# --- categories ---

HISTORY = f"""history AS (
    SELECT DISTINCT grp AS region, {month('recorded_at')} AS month,
        {title('trim(category)')} AS category, upper(trim(geo)) AS geo,
        power(0.5::DOUBLE, datediff('month', {month('recorded_at')}, {FLOOR}) / 60.0::DOUBLE)
            AS weight
    FROM records
    WHERE recorded_at < {FLOOR} AND recorded_at >= {FLOOR} - INTERVAL 180 MONTH)"""
ROLES = """roles AS (
    SELECT CAST(m AS INTEGER) AS moy, CAST(t AS INTEGER) AS target, role
    FROM generate_series(1, 12) AS a(m), generate_series(1, 12) AS b(t),
        (VALUES ('exact'), ('neighbour'), ('overall')) AS r(role)
    WHERE role = 'overall' OR (role = 'exact' AND m = t)
        OR (role = 'neighbour' AND (m - t + 12) % 12 IN (1, 11)))"""
SCORES = f"""{HISTORY}, {ROLES},
occurred AS (SELECT DISTINCT region, month, category, weight FROM history),
seen_years AS (
    SELECT region, month(month) AS target, count(DISTINCT year(month)) AS exact_years
    FROM occurred GROUP BY 1, 2),
weights AS (
    SELECT region, target, role, category, sum(weight) AS weight,
        count(*) FILTER (WHERE role = 'exact') AS years
    FROM occurred JOIN roles ON moy = month(month) GROUP BY 1, 2, 3, 4),
shares AS (
    SELECT *, weight / sum(weight) OVER (PARTITION BY region, target, role) AS share,
        bool_or(role = 'neighbour') OVER (PARTITION BY region, target) AS near
    FROM weights),
blended AS (
    SELECT s.*, CASE WHEN exact_years >= 8 THEN 0.70 WHEN exact_years >= 4 THEN 0.55
            WHEN exact_years >= 1 THEN 0.40 ELSE 0.0 END::DOUBLE AS e,
        CASE WHEN NOT near THEN 0.0 WHEN exact_years >= 8 THEN 0.20 WHEN exact_years >= 4 THEN 0.25
            WHEN exact_years >= 1 THEN 0.30 ELSE 0.45 END::DOUBLE AS a
    FROM shares s LEFT JOIN seen_years y USING (region, target)),
raw_scores AS (
    SELECT region, target AS month_number, category,
        sum(share * CASE role WHEN 'exact' THEN e WHEN 'neighbour' THEN a ELSE 1 - e - a END)
            AS score,
        max(years) AS category_years
    FROM blended GROUP BY 1, 2, 3),
scores AS (
    SELECT region, month_number, category,
        round(score / sum(score) OVER (PARTITION BY region, month_number), 12) AS score,
        category_years
    FROM raw_scores)"""
ESTIMATES = f"""{SCORES},
likely AS (
    SELECT region, month_number, category AS likelyIncidentType,
        round_even(score * 100, 1) AS incidentTypeSupport,
        CASE WHEN score * 100 >= 50 AND category_years >= 5 THEN '{STRONG}'
            WHEN score * 100 >= 32 AND category_years >= 3 THEN '{MODERATE}'
            ELSE '{LIMITED}' END AS incidentTypeConfidence
    FROM scores
    QUALIFY row_number() OVER (PARTITION BY region, month_number ORDER BY score DESC, category) = 1),
places AS (
    SELECT l.region, l.month_number, h.geo, role,
        weight * CASE role WHEN 'neighbour' THEN 0.35::DOUBLE ELSE 1.0::DOUBLE END AS weight,
        bool_or(role <> 'overall') OVER (PARTITION BY l.region, l.month_number) AS near
    FROM likely l JOIN history h ON h.region = l.region AND h.category = l.likelyIncidentType
        JOIN roles ON target = l.month_number AND moy = month(h.month)),
place_scores AS (
    SELECT region, month_number, geo, round(sum(weight), 12) AS score
    FROM places WHERE (role <> 'overall') = near AND geo <> '{REGION_WIDE}' GROUP BY 1, 2, 3),
best_places AS (
    SELECT *, row_number() OVER (PARTITION BY region, month_number ORDER BY score DESC, geo) AS nth
    FROM place_scores),
areas AS (
    SELECT region, month_number, string_agg(geo, ', ' ORDER BY nth) AS likelyAreas
    FROM best_places WHERE nth <= 3 GROUP BY 1, 2),
estimates AS (
    SELECT likely.*, coalesce(likelyAreas, '{REGION_WIDE}') AS likelyAreas
    FROM likely LEFT JOIN areas USING (region, month_number))"""


def forecast_sql(horizon: int, history_months: int, where: str = "TRUE") -> str:
    """The whole forecast table as a CTE named forecast."""
    return f"""{series_sql('grp')}, {volumes_sql(horizon)}, {ESTIMATES},
stacked AS (
    SELECT region, month, 'Historical' AS recordType, CAST(n AS BIGINT) AS declarationRecords,
        NULL::BIGINT AS lowerEstimate, NULL::BIGINT AS upperEstimate,
        NULL::VARCHAR AS likelyIncidentType, NULL::DOUBLE AS incidentTypeSupport,
        NULL::VARCHAR AS incidentTypeConfidence, NULL::VARCHAR AS likelyAreas
    FROM series WHERE months - position <= {history_months}
    UNION ALL
    SELECT v.region, v.month, 'Forecast', declarationRecords, lowerEstimate, upperEstimate,
        coalesce(likelyIncidentType, '{NO_HISTORY}'), coalesce(incidentTypeSupport, 0.0),
        coalesce(incidentTypeConfidence, '{LIMITED}'), coalesce(likelyAreas, '{REGION_WIDE}')
    FROM volumes v LEFT JOIN estimates e
        ON e.region = v.region AND e.month_number = month(v.month)),
forecast AS (
    SELECT stacked.*,
        'Backtested ' || model || CASE WHEN validation_mae IS NULL
            THEN '; limited-history validation'
            ELSE printf('; 12-month holdout MAE %.1f records', round_even(validation_mae, 1))
            END AS method,
        '{CATEGORY_METHOD}' AS incidentTypeMethod,
        '{CATEGORY_LIMITATION}' AS incidentTypeLimitation,
        '2001-08-15T00:00:00+00:00' AS generatedAt, '2001-08-15' AS asOfDate,
        strftime(last, '%Y-%m') AS trainingThrough, '2001-09' AS forecastStart,
        {rounded('validation_mae')} AS validationMae
    FROM stacked JOIN chosen USING (region) JOIN bounds USING (region)
    WHERE {where})"""


STORED_FLOOR = "DATE '1999-06-01'"
STORED = f"""{series_sql('geo')},
stored AS (
    SELECT region, month,
        CASE WHEN month >= {STORED_FLOOR} THEN 'Forecast' ELSE 'Historical' END AS recordType,
        n AS declarationRecords,
        CASE WHEN month >= {STORED_FLOOR} AND n * 2 >= avg(n) OVER (PARTITION BY region)
            THEN 'Some' END AS likelyIncidentType
    FROM series),
shown AS (
    SELECT * FROM stored
    QUALIFY (recordType = 'Forecast'
            AND row_number() OVER (PARTITION BY region, recordType ORDER BY month) <= 6)
        OR (recordType = 'Historical'
            AND row_number() OVER (PARTITION BY region, recordType ORDER BY month DESC) <= 24)),
usable AS (
    SELECT region FROM shown WHERE recordType = 'Forecast' GROUP BY 1
    HAVING count(*) >= 6 AND min(month) = {STORED_FLOOR}
        AND count(*) = count(likelyIncidentType))"""


def as_of_stored(sql: str) -> str:
    """SQL of the forecast by place, and as of the day of the stored one."""
    return (
        sql.replace(FLOOR, "DATE '1999-05-01'")
        .replace(FIRST_FORECAST, STORED_FLOOR)
        .replace("grp AS region", "geo AS region")
    )


def breakdown(fields: dict[str, str], name: str, count: str, source: str = "records") -> str:
    return " UNION ALL ".join(
        f"SELECT '{field}' AS {name}, {e} AS value, count(*) AS {count} FROM {source} "
        f"WHERE {e} IS NOT NULL GROUP BY 2"
        for field, e in fields.items()
    )


YEAR_TEXT = "CAST(year(recorded_at) AS VARCHAR)"
FIELDS = {
    "year": YEAR_TEXT,
    "month": "strftime(recorded_at, '%m')",
    "geo": "geo",
    "group": "grp",
    "category": "category",
    "type_label": "type_label",
}
FINDINGS = {
    "total": "'records'",
    "year": YEAR_TEXT,
    "month": f"{MONTHS}[month(recorded_at)]",
    "incident_type": "category",
    "state": "geo",
    "region": "grp",
}
METADATA = {
    "states": "geo",
    "regions": "grp",
    "incident_types": "category",
    "declaration_types": "type_label",
    "years": YEAR_TEXT,
}
DESCRIBED = "CASE grp " + " ".join(
    f"WHEN '{r}' THEN '{r} — {REGION_NAMES[r]} ({REGION_AREAS[r]})'" for r in REGION_NAMES
) + " ELSE grp END"
SHORT = "CASE grp " + " ".join(
    f"WHEN '{r}' THEN '{r} — {REGION_NAMES[r]}'" for r in REGION_NAMES
) + " ELSE grp END"
RAW_TEXT = ["state", "declarationType", "incidentType", "declarationTitle", "designatedArea",
            "designatedIncidentTypes"]
RAW_NUMBERS = ["disasterNumber", "region"]
RAW_DATES = ["declarationDate", "lastRefresh"]
SEASON_MONTHS = "CASE name " + " ".join(
    f"WHEN '{s}' THEN '{', '.join(MONTH_NAMES[m - 1] for m in months)}'"
    for s, months in SEASONS.items()
) + " END"

REPEATED = """repeated AS (
    SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_linenumber = 1)"""


def per_entity(with_: str, source: str) -> str:
    return f"""WITH {with_}, counted AS (
            SELECT count(*) AS n, count(DISTINCT entity) AS e FROM {source})
        SELECT n AS declaration_records, e AS unique_disaster_numbers,
            CASE WHEN e > 0 THEN round_even(n / e, 2) ELSE 0.0 END AS records_per_disaster,
            format('{{:,}} records belong to {{:,}} disasters: {{}} for each, as every area has '
                || 'its own record.',
                n, e, printf('%.2f', round_even(n / e, 2))) AS interpretation
        FROM counted"""


ORACLE: dict[str, str] = {
    "filter_records": f"""WITH {RECORDS}
        SELECT id, entity, recorded_at, geo, grp, category, type_label, area FROM records
        WHERE {IN_RANGE} AND grp = '{REGION}' AND category IN ({quoted(CATEGORIES)})
            AND type_label IN ('Filled', 'P')""",
    "filter_years_swapped": """SELECT o_orderkey AS id, o_orderdate AS recorded_at,
            o_orderpriority AS category
        FROM orders WHERE year(o_orderdate) = 1999""",
    "filter_years": """SELECT o_orderkey AS id, o_orderdate AS recorded_at,
            o_orderpriority AS category
        FROM orders WHERE year(o_orderdate) BETWEEN 1997 AND 1999""",
    "date_range_default": """SELECT CAST(min(o_orderdate) AS DATE) AS start_date,
            CAST(max(o_orderdate) AS DATE) AS end_date, count(o_orderdate) AS dated_records
        FROM orders""",
    "summary_kpis": f"""WITH {SELECTED}
        SELECT count(*) AS declaration_records, count(DISTINCT entity) AS unique_disaster_numbers,
            (SELECT geo FROM selected GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top_state,
            (SELECT category FROM selected GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
                AS top_incident_type,
            (SELECT CAST(year(recorded_at) AS INTEGER) FROM selected GROUP BY 1
                ORDER BY count(*) DESC, 1 LIMIT 1) AS peak_year
        FROM selected""",
    "trend_year": f"""WITH {SELECTED} SELECT {YEAR_TEXT} AS period,
        count(*) AS declaration_records FROM selected GROUP BY 1""",
    "trend_month": f"""WITH {SELECTED} SELECT strftime(recorded_at, '%Y-%m') AS period,
        count(*) AS declaration_records FROM selected GROUP BY 1""",
    "trend_events_month": """SELECT strftime(ts, '%Y-%m') AS period,
        count(*) AS declaration_records FROM events GROUP BY 1""",
    "group_counts": f"""WITH {RECORDS} SELECT grp AS name, count(*) AS declaration_records
        FROM records WHERE {IN_RANGE} GROUP BY 1""",
    "top_categories": top("selected", "category", 3, SELECTED),
    "top_geos": top("records", "geo", 10),
    "top_geo_category": f"""WITH {RECORDS} SELECT geo, category, count(*) AS declaration_records
        FROM records GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 25""",
    "type_label_counts": f"""WITH {RECORDS} SELECT type_label AS name,
        count(*) AS declaration_records FROM records GROUP BY 1""",
    "month_counts": f"""SELECT CAST(month(o_orderdate) AS INTEGER) AS month,
            {MONTHS}[month(o_orderdate)] AS monthName, count(*) AS declaration_records
        FROM orders GROUP BY 1, 2""",
    "seasonality": f"WITH {SEASONALITY} SELECT * FROM months",
    "season_rollup": f"""WITH {SEASONALITY} SELECT {SEASON} AS name,
            CAST({SEASON_ORDER} AS INTEGER) AS season_order,
            CAST(sum(declaration_records) AS BIGINT) AS declaration_records
        FROM months GROUP BY 1, 2""",
    "metadata_values": f"""WITH {RECORDS}
        SELECT field, value FROM ({breakdown(METADATA, 'field', 'n')})
        UNION ALL SELECT 'minimum_date', CAST(CAST(min(recorded_at) AS DATE) AS VARCHAR)
            FROM records
        UNION ALL SELECT 'maximum_date', CAST(CAST(max(recorded_at) AS DATE) AS VARCHAR)
            FROM records""",
    "record_cube": f"""WITH {RECORDS} SELECT {month('recorded_at')} AS recorded_at, geo, grp,
            category, type_label, count(*) AS records
        FROM records GROUP BY 1, 2, 3, 4, 5""",
    "shared_breakdowns": f"WITH {RECORDS} {breakdown(FIELDS, 'field', 'declaration_records')}",
    "clean_text": f"""SELECT doc_id, {clean('text')} AS cleaned,
            CASE WHEN lang <> 'en' THEN source ELSE 'Not Reported' END AS filled,
            upper(lang) AS code
        FROM documents""",
    "title_case": f"SELECT doc_id, {title('text')} AS title FROM documents",
    "parse_cast": f"""WITH {RAW_TABLE}, numbered AS (
            SELECT id, {whole('region')} AS region, {whole('disasterNumber')} AS entity,
                {parsed('declarationDate')} AS recorded_at,
                {parsed('lastRefresh')} AS refreshed_at
            FROM raw)
        SELECT *, {REGION_LABEL} AS region_label FROM numbered""",
    "date_parts": f"""SELECT o_orderkey AS id, CAST(year(o_orderdate) AS INTEGER) AS year,
            CAST(month(o_orderdate) AS INTEGER) AS month,
            CAST(quarter(o_orderdate) AS INTEGER) AS quarter,
            {MONTHS}[month(o_orderdate)] AS month_name,
            strftime(o_orderdate, '%Y-%m') AS month_year,
            CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS date_key,
            CAST(o_orderdate AS DATE) AS full_date, {month('o_orderdate')} AS month_start,
            CAST({month('o_orderdate')} + INTERVAL 1 MONTH AS DATE) AS next_month,
            CAST(datediff('month', o_orderdate, {FLOOR}) AS INTEGER) AS age,
            CAST(month({month('o_orderdate')} - INTERVAL 1 MONTH) AS INTEGER) AS month_before,
            CAST(month({month('o_orderdate')} + INTERVAL 1 MONTH) AS INTEGER) AS month_after
        FROM orders""",
    "region_labels": f"""WITH {RECORDS} SELECT grp,
            CAST(substring(grp, 8) AS INTEGER) AS region_order,
            {DESCRIBED} AS description, {SHORT} AS short_description,
            count(*) AS declaration_records
        FROM records GROUP BY 1""",
    "normalise_records": f"WITH {TYPED} {normalised('typed')}",
    "normalise_dirty": f"WITH {TIDY} SELECT * FROM tidy",
    "clean_dirty": f"""WITH {TYPED_DIRTY}
        SELECT DISTINCT *, {DATE_PARTS}, {REGION_LABEL} AS femaRegion FROM typed""",
    "missing_columns": f"""WITH {TYPED}, bare AS (
            SELECT * REPLACE (NULL::VARCHAR AS declarationType, NULL::VARCHAR AS designatedArea,
                NULL::INTEGER AS region)
            FROM typed)
        {normalised('bare')}""",
    "last_refresh": f"WITH {TIDY} SELECT max(lastRefresh) AS latest_refresh FROM tidy",
    "group_counts_dirty": f"""WITH {TIDY}
        SELECT femaRegion AS name, count(*) AS declaration_records FROM tidy
        WHERE femaRegion <> 'Not Reported' GROUP BY 1""",
    "top_regions_dirty": f"""WITH {TIDY}, best AS (
            SELECT femaRegion AS name, count(*) AS declaration_records FROM tidy
            GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)
        SELECT * FROM best WHERE name <> 'Not Reported'""",
    "category_history_dirty": f"""WITH {TIDY}
        SELECT DISTINCT femaRegion AS region, {month('declarationDate')} AS month,
            {title('trim(incidentType)')} AS category,
            CASE WHEN upper(trim(state)) IN ('', 'NOT REPORTED') THEN '{REGION_WIDE}'
                ELSE upper(trim(state)) END AS geo,
            {rounded(f"power(0.5::DOUBLE, datediff('month', {month('declarationDate')}, {FLOOR})"
                     " / 60.0::DOUBLE)")} AS weight
        FROM tidy
        WHERE femaRegion <> 'Not Reported' AND incidentType <> 'Not Reported'
            AND declarationDate < {FLOOR} AND declarationDate >= {FLOOR} - INTERVAL 180 MONTH""",
    "clean_records": f"""WITH {TYPED}
        SELECT DISTINCT *, {DATE_PARTS}, {REGION_LABEL} AS femaRegion FROM typed""",
    "dedupe_latest": """SELECT * FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC,
            l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC,
            l_quantity DESC, l_discount DESC, l_tax DESC, l_returnflag DESC,
            l_linestatus DESC) = 1""",
    "distinct_rows": f"WITH {REPEATED} SELECT DISTINCT * FROM repeated",
    "profile_nulls": f"WITH {TYPED} " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing FROM typed"
        for c in RAW
    ),
    "profile_sizes": f"""WITH {REPEATED}
        SELECT count(*) AS total_rows, CAST(11 AS INTEGER) AS total_columns,
            count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM repeated)) AS duplicate_rows
        FROM repeated""",
    "profile_removed": f"""WITH {REPEATED}, kept AS (SELECT DISTINCT * FROM repeated)
        SELECT count(*) AS rows_before, (SELECT count(*) FROM kept) AS rows_after,
            count(*) - (SELECT count(*) FROM kept) AS duplicates_removed
        FROM repeated""",
    "profile_columns": f"""WITH {TYPED_DIRTY}, points AS (
            SELECT 'rows' AS metric, NULL::VARCHAR AS name, count(*) AS n, NULL::TIMESTAMP AS at
            FROM typed
            UNION ALL SELECT 'earliest', NULL, NULL, min(declarationDate) FROM typed
            UNION ALL SELECT 'latest', NULL, NULL, max(declarationDate) FROM typed
            UNION ALL SELECT 'year', CAST(year(declarationDate) AS VARCHAR), count(*), NULL
            FROM typed WHERE declarationDate IS NOT NULL GROUP BY 2
            UNION ALL SELECT 'incidentType', incidentType, count(*), NULL
            FROM typed WHERE incidentType IS NOT NULL GROUP BY 2
            UNION ALL SELECT 'state', state, count(*), NULL
            FROM typed WHERE state IS NOT NULL GROUP BY 2"""
    + "".join(
        f" UNION ALL SELECT 'missing', '{c}', count(*) - count({c}), NULL FROM typed" for c in RAW
    )
    + ") SELECT * FROM points",
    "findings": f"""WITH {RECORDS}, counted AS ({breakdown(FINDINGS, 'metric', 'records')})
        SELECT metric, value AS name, records FROM counted
        QUALIFY row_number() OVER (PARTITION BY metric ORDER BY records DESC, value) = 1""",
    "health": """SELECT 'ok' AS status, 'Order tables' AS data_source, FALSE AS sample_mode,
        count(*) AS declaration_records FROM orders""",
    "table_sizes": f"""WITH {RECORDS}
        SELECT 'rows:fact' AS metric, count(*) AS value FROM records
        UNION ALL SELECT 'rows:dim_date', count(DISTINCT CAST(recorded_at AS DATE)) FROM records
        UNION ALL SELECT 'rows:dim_location', count(*)
            FROM (SELECT DISTINCT geo, grp, area FROM records)
        UNION ALL SELECT 'rows:dim_category', count(*)
            FROM (SELECT DISTINCT category, type_code FROM records)""",
    "dim_date": f"WITH {STAR_RECORDS} SELECT * FROM days",
    "dim_location": f"WITH {STAR_RECORDS} SELECT * FROM location",
    "dim_category": f"WITH {STAR_RECORDS} SELECT * FROM kind",
    "fact_records": f"WITH {STAR_RECORDS} SELECT * FROM fact",
    "star_summary": f"""WITH {STAR_RECORDS}
        SELECT year, grp, category, count(*) AS declarationCount
        FROM fact LEFT JOIN days USING (dateKey) LEFT JOIN location USING (locationKey)
            LEFT JOIN kind USING (incidentTypeKey)
        GROUP BY 1, 2, 3""",
    "star_dimensions": f"""WITH {STAR_RECORDS}
        SELECT 'date' AS dimension, CAST(dateKey AS BIGINT) AS key, concat_ws('|', fullDate, year,
            month, monthName, quarter, monthYear) AS natural_key FROM days
        UNION ALL SELECT 'location', locationKey, concat_ws('|', coalesce(geo, '-'),
            coalesce(grp, '-'), coalesce(CAST(region_number AS VARCHAR), '-'), coalesce(area, '-'))
        FROM location
        UNION ALL SELECT 'kind', incidentTypeKey, concat_ws('|', coalesce(category, '-'),
            coalesce(codes, '-'))
        FROM kind""",
    "sample_head": """SELECT o_orderkey AS id, o_orderdate AS recorded_at FROM orders
        ORDER BY o_orderdate DESC, o_orderkey LIMIT 1000""",
    "sample_systematic": """WITH placed AS (
            SELECT o_orderkey AS id, o_orderdate AS recorded_at, o_orderpriority AS category,
                row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) - 1 AS place,
                count(*) OVER () AS total
            FROM orders),
        positions AS (
            SELECT CASE WHEN total <= 1000 THEN i ELSE i * total // 1000 END AS place
            FROM (SELECT count(*) AS total FROM orders), generate_series(0, 999) AS g(i))
        SELECT id, recorded_at, category FROM placed
        WHERE total <= 1000 OR place IN (SELECT place FROM positions)""",
    "head_per_group": f"""WITH {RECORDS} SELECT grp, id, recorded_at FROM records
        QUALIFY row_number() OVER (PARTITION BY grp ORDER BY recorded_at, id) <= 12""",
    "first_of_regions": f"""WITH {RECORDS} SELECT grp, id, recorded_at FROM records
        QUALIFY row_number() OVER (PARTITION BY grp ORDER BY recorded_at, id) <= 1500""",
    "newest_first_files": """SELECT o_orderkey AS id, o_orderdate AS recorded_at,
            o_orderpriority AS category,
            row_number() OVER (ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) - 1 AS position
        FROM orders""",
    "broken_lines": f"""WITH {RAW_TABLE}, broken AS (
            SELECT CAST(o_orderkey AS VARCHAR) AS key, {BROKEN_TITLE} AS title FROM {PLACES})
        SELECT id, title AS declarationTitle, state, lastRefresh
        FROM raw JOIN broken ON id = key""",
    "exported_listing": f"""WITH {TYPED}, tidy AS ({normalised('typed')})
        SELECT CAST(disasterNumber AS VARCHAR) AS disasterNumber, declarationDate, state, femaRegion,
            incidentType, declarationTypeLabel, declarationTitle, designatedArea
        FROM tidy
        WHERE declarationDate >= DATE '{START}' AND declarationDate < DATE '{END}' + 1
            AND femaRegion IN ('Region 3', 'Region 4')""",
    "exported_forecast": f"""WITH {forecast_sql(HORIZON, 12)}
        SELECT region, month, recordType, likelyIncidentType, {rounded('incidentTypeSupport')}
                AS incidentTypeSupport, incidentTypeConfidence, likelyAreas, declarationRecords,
            lowerEstimate, upperEstimate
        FROM forecast""",
    "reread_forecast": f"""WITH {STORED}
        SELECT * FROM stored WHERE month(month) NOT IN (5, 6, 10)""",
    "best_source": f"""WITH {TYPED}, tidy AS ({normalised('typed')})
        SELECT 'Local raw dataset' AS data_source, FALSE AS sample_mode, femaRegion,
            count(*) AS declaration_records
        FROM tidy GROUP BY 3""",
    "insight_top_month": f"""WITH {SEASONALITY} SELECT name, declaration_records FROM months
        ORDER BY 2 DESC, month LIMIT 1""",
    "insight_top_season": f"""WITH {SEASONALITY}, seasons AS (
            SELECT {SEASON} AS name, min({SEASON_ORDER}) AS season_order,
                CAST(sum(declaration_records) AS BIGINT) AS declaration_records
            FROM months GROUP BY 1)
        SELECT name, declaration_records, {SEASON_MONTHS} AS months FROM seasons
        ORDER BY declaration_records DESC, season_order LIMIT 1""",
    "insight_top_regions": f"""WITH {RECORDS}, best AS (
            SELECT grp AS name, count(*) AS declaration_records FROM records
            GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)
        SELECT * FROM best WHERE name <> 'Not Reported'""",
    "insight_trend": trend_sql(USED, "round_even({}, 1)".format),
    "insight_trend_from_cube": trend_sql(
        f"used AS (SELECT * FROM yearly WHERE year < {YEAR})", rounded
    ),
    "insight_spikes": f"""WITH {YEARLY}, {USED}, kinds AS (
            SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS category,
                count(*) AS k
            FROM orders GROUP BY 1, 2
            QUALIFY row_number() OVER (PARTITION BY year ORDER BY k DESC, category) = 1)
        SELECT year, n AS declaration_records, category AS top_incident_type,
            k AS top_incident_records, round_even(k * 100 / n, 1) AS share,
            format('Of the records of {{}}, {{:,}} in all, {{}} accounts for the largest part: '
                || '{{:,}}, or {{}}%.', year, n, category, k,
                printf('%.1f', round_even(k * 100 / n, 1))) AS explanation
        FROM used JOIN kinds USING (year) ORDER BY n DESC, year LIMIT 3""",
    "insight_records_vs_entities": per_entity(SELECTED, "selected"),
    "monthly_series_region": f"WITH {series_sql('grp')} SELECT * FROM series",
    "monthly_series_place": f"WITH {series_sql('geo')} SELECT * FROM series",
    "seasonal_naive": f"""WITH {series_sql('geo')}, {predictions_sql(HORIZON)}
        SELECT region, month, {rounded('seasonal')} AS seasonal FROM predicted WHERE step > 0""",
    "level_adjustment": f"""WITH {series_sql('geo')}, {FITS}, {SEASONAL}
        SELECT region, fit, size, {rounded('recent_mean')} AS recent_mean,
            {rounded('previous_mean')} AS previous_mean, {rounded('level')} AS level
        FROM levels""",
    "lag_residual_scale": f"""WITH {series_sql('geo')}, {predictions_sql(1)},
        {scale_sql('SELECT region, residual FROM lagged')}
        SELECT region, {rounded('scale')} AS scale FROM scales""",
    "regression_sums": f"""WITH {series_sql('grp')}, {FITS}, {SUMS}
        SELECT region, fit, origin, training_months, """
    + ", ".join(f"{rounded(f'xx_{i}_{j}')} AS xx_{i}_{j}" for i, j in PAIRS)
    + ", "
    + ", ".join(f"{rounded(f'xy_{i}')} AS xy_{i}" for i in range(8))
    + " FROM sums",
    "regression_forecast": f"""WITH {series_sql('geo')}, {predictions_sql(HORIZON)}
        SELECT region, month, {rounded('regression')} AS regression
        FROM predicted WHERE step > 0""",
    "backtest_selection": f"""WITH {series_sql('geo')}, {predictions_sql(1)}
        SELECT region, model, {rounded('regression_mae')} AS regression_mae,
            {rounded('seasonal_mae')} AS seasonal_mae,
            {rounded('validation_mae')} AS validation_mae
        FROM chosen""",
    "volume_forecast": f"""WITH {series_sql('geo')}, {volumes_sql(HORIZON)}
        SELECT * REPLACE ({rounded('validation_mae')} AS validation_mae) FROM volumes""",
    "category_history": f"""WITH {RECORDS}, {HISTORY}
        SELECT region, month, category, geo, {rounded('weight')} AS weight FROM history""",
    "category_scores": f"""WITH {RECORDS}, {SCORES}
        SELECT region, month_number, category, {rounded('score', 9)} AS score,
            CAST(category_years AS BIGINT) AS category_years
        FROM scores""",
    "category_estimates": f"WITH {RECORDS}, {ESTIMATES} SELECT * FROM estimates",
    "group_forecast": f"WITH {forecast_sql(HORIZON, 60)} SELECT * FROM forecast",
    "one_group_forecast": f"""WITH {forecast_sql(6, 24, f"region = '{REGION}'")}
        SELECT region, strftime(month, '%Y-%m') AS month, recordType AS record_type,
            declarationRecords AS declaration_records, lowerEstimate AS lower_estimate,
            upperEstimate AS upper_estimate, likelyIncidentType AS likely_incident_type,
            incidentTypeSupport AS incident_type_support,
            incidentTypeConfidence AS incident_type_confidence, likelyAreas AS likely_areas,
            method, incidentTypeMethod AS type_method, incidentTypeLimitation AS type_limitation,
            generatedAt AS generated_at, asOfDate AS as_of_date,
            trainingThrough AS training_through, forecastStart AS forecast_start,
            validationMae AS validation_mae
        FROM forecast""",
    "forecast_serving_slice": f"""WITH {STORED}
        SELECT shown.* FROM shown SEMI JOIN usable USING (region)""",
    "served_forecast": f"""WITH {STORED},
        fresh AS (WITH {as_of_stored(forecast_sql(6, 24))} SELECT * FROM forecast)
        SELECT region, month, recordType, declarationRecords, NULL::BIGINT AS lowerEstimate,
            NULL::BIGINT AS upperEstimate, likelyIncidentType, 1.0::DOUBLE AS incidentTypeSupport,
            '{REGION_WIDE}' AS likelyAreas, NULL::VARCHAR AS method, NULL::DOUBLE AS validationMae
        FROM shown SEMI JOIN usable USING (region)
        UNION ALL SELECT region, month, recordType, declarationRecords, lowerEstimate, upperEstimate,
            likelyIncidentType, {rounded('incidentTypeSupport')}, likelyAreas, method, validationMae
        FROM fresh ANTI JOIN usable USING (region)""",
    "forecast_comparison": f"""WITH {forecast_sql(HORIZON, 12)},
        ahead AS (SELECT * FROM forecast WHERE recordType = 'Forecast'),
        peaks AS (
            SELECT region, month AS peak_month, declarationRecords AS peak_records FROM ahead
            QUALIFY row_number() OVER (PARTITION BY region
                ORDER BY declarationRecords DESC, month) = 1),
        kinds AS (
            SELECT region, likelyIncidentType AS leading_incident_type,
                arg_min(likelyAreas, month) AS leading_areas
            FROM ahead GROUP BY 1, 2
            QUALIFY row_number() OVER (PARTITION BY region
                ORDER BY sum(declarationRecords) DESC, likelyIncidentType) = 1),
        totals AS (
            SELECT region, CAST(sum(declarationRecords) AS BIGINT) AS forecast_records,
                {rounded('avg(declarationRecords)')} AS average_month
            FROM ahead GROUP BY 1)
        SELECT * FROM totals JOIN peaks USING (region) JOIN kinds USING (region)""",
    "comparison_regions": f"""WITH {RECORDS} SELECT grp AS region FROM records GROUP BY 1
        ORDER BY CASE grp WHEN 'Region 4' THEN 1 WHEN 'Region 6' THEN 2 WHEN 'Region 9' THEN 3
            ELSE 99 END, CAST(substring(grp, 8) AS INTEGER) LIMIT 3""",
    "forecast_sizes": f"""WITH {forecast_sql(HORIZON, 12)}
        SELECT count(DISTINCT region) AS regions_forecasted,
            count(*) FILTER (WHERE recordType = 'Forecast') AS forecast_rows
        FROM forecast""",
}


def finding_rows() -> str:
    """All findings as one table."""
    months = ORACLE["month_counts"]
    seasons = f"""SELECT {SEASON} AS name, min({SEASON_ORDER}) AS season_order,
        sum(declaration_records) AS declaration_records FROM ({months}) GROUP BY 1"""
    plain = ("name", "declaration_records", "NULL")
    sections = {
        "top_month": (*plain, f"SELECT monthName AS name, declaration_records FROM ({months}) "
                      "ORDER BY 2 DESC, month LIMIT 1"),
        "top_season": ("name", "declaration_records", SEASON_MONTHS,
                       f"FROM ({seasons}) ORDER BY declaration_records DESC, season_order LIMIT 1"),
        "top_states": (*plain, top("records", "geo", 5)),
        "top_incident_types": (*plain, top("records", "category", 5)),
        "top_regions": (*plain, top("records", "grp", 5)),
        "long_term_trend": ("direction", "NULL", "interpretation", ORACLE["insight_trend"]),
        "historical_spikes": ("year", "declaration_records", "explanation",
                              ORACLE["insight_spikes"]),
        "records_vs_disasters": ("NULL", "declaration_records", "interpretation",
                                 per_entity(RECORDS, "records")),
    }
    return " UNION ALL ".join(
        f"""SELECT '{section}' AS section, CAST({name} AS VARCHAR) AS name,
            CAST({n} AS BIGINT) AS declaration_records, CAST({text} AS VARCHAR) AS text,
            {f"'{LIMITATIONS[section]}'" if section in LIMITATIONS else "NULL::VARCHAR"}
                AS limitation
        FROM ({source})"""
        for section, (name, n, text, source) in sections.items()
    )


def totals_rows() -> str:
    """The findings from published totals as one table."""
    sql = finding_rows()
    replaced = {
        f"({ORACLE['insight_trend']})": f"({ORACLE['insight_trend_from_cube']})",
        f"({ORACLE['insight_spikes']})": f"""(WITH {YEARLY}
            SELECT year, n AS declaration_records,
                printf('%d is among the years with most records.', year) AS explanation
            FROM yearly WHERE year < {YEAR} ORDER BY n DESC, year LIMIT 3)""",
        f"({top('records', 'grp', 5)})": f"""(WITH {RECORDS}
            SELECT grp AS name, count(*) AS declaration_records, min(region_number) AS place
            FROM records GROUP BY 1 ORDER BY place LIMIT 5)""",
        f"({per_entity(RECORDS, 'records')})": """(SELECT count(*) AS declaration_records,
                printf('A disaster has about %.2f records.',
                    round_even(count(*) / count(DISTINCT o_custkey), 2)) AS interpretation
            FROM orders)""",
    }
    for old, new in replaced.items():
        if old not in sql:
            raise ValueError(f"Not part of the findings: {old[:80]}")
        sql = sql.replace(old, new)
    return sql


ORACLE["insights_all"] = finding_rows()
ORACLE["totals_findings"] = totals_rows()
# What an empty selection gives: twelve months without records, and a ratio of nothing.
ORACLE["empty_results"] = " UNION ALL ".join(
    f"SELECT '{result}' AS result, CAST({rows} AS BIGINT) AS value FROM (SELECT count(*) FROM orders)"
    for result, rows in {
        "summary": 0, "trend": 0, "top_values": 0, "region_counts": 0, "metadata": 0,
        "seasonality": 12, "findings": 0, "date_range": 0, "forecast": 0, "insights.top_month": 0,
        "insights.top_season": 0, "insights.top_states": 0, "insights.top_incident_types": 0,
        "insights.top_regions": 0, "insights.long_term_trend": 0, "insights.historical_spikes": 0,
        "insights.records_vs_disasters": 1,
    }.items()
)
