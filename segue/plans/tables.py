"""Table access and inputs derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from segue.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Column expressions below read the same in Spark SQL and in DuckDB.
URL_VARIANTS = [
    "url",
    "replace(url, 'http://', 'https://')",
    "concat('https://tv.example.com/videos/', page_id)",
    "concat('https://TV.example.com:8443/User', page_id)",
    "'https://tv.example.com/directory'",
    "concat('https://www.example.com/u', page_id, '/status/', page_id)",
    "concat('https://clip.example.net/c/', page_id, '/', hex(page_id + 11259375))",
    "concat('https://clip.example.net/', page_id, '?x=1&h=k', page_id)",
    "concat('https://player.example.net/video/', page_id, '?h=z')",
    "concat('https://shop.store.example.org/track/', page_id)",
    "'https://127.0.0.1/x'",
    "'https://localhost/x'",
    "'not a url'",
    "concat('https://evil.test', chr(92), '@tv.example.com/videos/', page_id)",
    "concat('https://tv.example.com:65536/videos/', page_id)",
    "concat('https://u:p@tv.example.com:65535', chr(92), 'videos', chr(92), page_id)",
    "concat('https://tv.example.com:00443/videos/', page_id)",
]


def url_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    variants = ", ".join(URL_VARIANTS)
    return table(spark, sf_dir, "pages").selectExpr(
        "page_id", f"posexplode(array({variants})) as (variant, url)")


URL_REQUESTS_SQL = (
    "SELECT page_id, CAST(i - 1 AS INTEGER) AS variant, list_extract(vs, i) AS url FROM ("
    f"SELECT page_id, [{', '.join(URL_VARIANTS)}] AS vs FROM pages), "
    f"range(1, {len(URL_VARIANTS) + 1}) r(i)"
)


# ---- track catalog (one analysis record per part) --------------------------


def _catalog_columns(duck: bool) -> dict[str, str]:
    """Analysis record expressions over ``part`` in one of the two dialects."""

    def div(a: str, b: str) -> str:
        return f"(({a}) // ({b}))" if duck else f"(({a}) div ({b}))"

    def each(count: str, body: str) -> str:
        if duck:
            return f"list_transform(range(CAST({count} AS BIGINT)), lambda i: {body})"
        return f"transform(sequence(0L, CAST({count} AS BIGINT) - 1), i -> {body})"

    p = "p_partkey"
    size = "CAST(p_size AS BIGINT)"
    seconds = f"(20 + {size})"
    bpm = f"(70 + 2 * {size})"
    first_beat = f"(100000 + ({p} % 10) * 20000)"
    empty = "CAST([] AS BIGINT[])" if duck else "CAST(array() AS ARRAY<BIGINT>)"
    empty_d = "CAST([] AS DOUBLE[])" if duck else "CAST(array() AS ARRAY<DOUBLE>)"
    markers = f"({div(f'({seconds} - 1) * {bpm}', '60')})"
    return {
        "track": p,
        "duration_us": f"{seconds} * 1000000",
        "audible_start_us": f"({p} % 5) * 100000",
        "audible_end_us": f"{seconds} * 1000000 - ({p} % 7) * 100000",
        "intro_end_us": f"CASE WHEN {p} % 3 <> 0 THEN ({p} % 5) * 100000 + 4000000 + ({p} % 4) * 1000000 END",
        "intro_confidence": f"CASE WHEN {p} % 3 <> 0 THEN CAST(50 + ({p} % 6) * 10 AS DOUBLE) / 100 ELSE CAST(0 AS DOUBLE) END",
        "outro_start_us": f"CASE WHEN {p} % 4 <> 0 THEN {seconds} * 1000000 - ({p} % 7) * 100000 - 5000000 - ({p} % 5) * 1000000 END",
        "outro_confidence": f"CASE WHEN {p} % 4 <> 0 THEN CAST(55 + ({p} % 5) * 10 AS DOUBLE) / 100 ELSE CAST(0 AS DOUBLE) END",
        "vocal_rate": f"CASE WHEN {p} % 9 = 0 THEN 0 ELSE 4 END",
        "vocal": f"CASE WHEN {p} % 9 = 0 THEN {empty} ELSE {each(f'{seconds} * 4', div(f'({p} * 31 + i * 17) % 256 * ({p} % 4)', '3'))} END",
        "vocal_conf": f"CASE WHEN {p} % 9 = 0 THEN {empty} ELSE {each(f'{seconds} * 4', f'100 + ({p} * 13 + i * 7) % 156')} END",
        "energy_rate": f"CASE WHEN {p} % 11 = 0 THEN 0 ELSE 4 END",
        "energy": f"CASE WHEN {p} % 11 = 0 THEN {empty} ELSE {each(f'{seconds} * 4', f'150 + ({p} * 31 + i * 5) % 96 - CASE WHEN {p} % 5 = 2 AND i < 20 THEN 120 ELSE 0 END')} END",
        "bpm": f"CASE WHEN {p} % 13 <> 0 THEN CAST({bpm} AS DOUBLE) END",
        "beat_confidence": f"CAST(40 + ({p} % 61) AS DOUBLE) / 100",
        "first_beat_us": f"CASE WHEN {p} % 13 <> 0 THEN {first_beat} END",
        "markers": f"CASE WHEN {p} % 8 = 0 OR {p} % 13 = 0 THEN {empty} ELSE {each(markers, first_beat + ' + ' + div('i * 60000000', bpm) + f' + ((i * {p}) % 5) * 4000')} END",
        "marker_conf": f"CASE WHEN {p} % 8 IN (0, 4) OR {p} % 13 = 0 THEN {empty_d} ELSE {each(markers, f'CAST(20 + ({p} + i * 3) % 80 AS DOUBLE) / 100')} END",
        "first_downbeat_us": f"CASE WHEN {p} % 13 <> 0 THEN {first_beat} + ({p} % 4) * {div('60000000', bpm)} END",
        "downbeat_confidence": f"CAST(({p} * 3) % 100 AS DOUBLE) / 100",
        "key_tonic": f"CASE WHEN {p} % 10 <> 0 THEN CAST({p} % 12 AS BIGINT) END",
        "key_minor": f"CASE WHEN {p} % 10 <> 0 THEN p_size % 2 = 1 END",
        "key_confidence": f"CASE WHEN {p} % 10 <> 0 THEN CAST(30 + ({p} * 7) % 70 AS DOUBLE) / 100 END",
        "rms_dbfs": f"CASE WHEN {p} % 17 <> 5 THEN CAST(({p} % 120) - 200 AS DOUBLE) / 10 END",
        "peak_dbfs": f"CASE WHEN {p} % 17 <> 5 THEN CAST(({p} % 60) - 60 AS DOUBLE) / 10 END",
    }


RECORDS = 5_000
"""Records of the catalog that a task makes, about; what sorts them later holds as many at once."""


def track_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a record has hundreds of values: the keys are spread first, as one small file would be one task
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    parts = spread(parts, "p_partkey", tasks=-(-parts.count() // RECORDS))
    return catalog_in_row(parts)


def catalog_in_row(parts: DataFrame, *keep: str) -> DataFrame:
    """The records of rows with ``p_partkey`` and ``p_size``, made where the rows are; columns named by ``keep`` stay."""
    return parts.selectExpr(*keep, *[f"{e} AS {n}" for n, e in _catalog_columns(False).items()])


TRACK_CATALOG_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in _catalog_columns(True).items()) + " FROM part"


def broken_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog with one injected violation per residue class of the key."""
    return track_catalog(spark, sf_dir).selectExpr(*BROKEN)


BROKEN_FIELDS = {
    "duration_us": "CASE WHEN track % 19 = 1 THEN CAST(0 AS BIGINT) ELSE duration_us END",
    "audible_end_us": "CASE WHEN track % 19 = 2 THEN duration_us + 1 ELSE audible_end_us END",
    "intro_end_us": "CASE WHEN track % 19 = 3 THEN audible_end_us + 1 ELSE intro_end_us END",
    "intro_confidence": "CASE WHEN track % 19 = 4 THEN CAST(2 AS DOUBLE) ELSE intro_confidence END",
    "vocal_rate": "CASE WHEN track % 19 = 5 THEN 9 ELSE vocal_rate END",
    "energy_rate": "CASE WHEN track % 19 = 6 THEN 3 ELSE energy_rate END",
    "bpm": "CASE WHEN track % 19 = 7 THEN CAST(-1 AS DOUBLE) ELSE bpm END",
    "beat_confidence": "CASE WHEN track % 19 = 8 THEN CAST('NaN' AS DOUBLE) ELSE beat_confidence END",
    "downbeat_confidence": "CASE WHEN track % 19 = 9 THEN CAST(-1 AS DOUBLE) ELSE downbeat_confidence END",
    "first_beat_us": "CASE WHEN track % 19 = 10 THEN duration_us + 5 ELSE first_beat_us END",
    "first_downbeat_us": "CASE WHEN track % 19 = 11 THEN duration_us + 5 ELSE first_downbeat_us END",
    "key_tonic": "CASE WHEN track % 19 = 12 THEN CAST(12 AS BIGINT) ELSE key_tonic END",
    "rms_dbfs": "CASE WHEN track % 19 = 13 THEN CAST('Infinity' AS DOUBLE) ELSE rms_dbfs END",
}
BROKEN = [f"{BROKEN_FIELDS.get(n, n)} AS {n}" for n in _catalog_columns(False)] + [
    "CASE WHEN track % 19 = 14 THEN true ELSE false END AS swap_markers",
    "CASE WHEN track % 19 = 15 THEN true ELSE false END AS short_conf"]
BROKEN_SQL = f"SELECT {', '.join(BROKEN)} FROM ({TRACK_CATALOG_SQL})"


def listener_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """queue(listener, pos, track): orders in key order; key ranges cut long queues."""
    from pyspark.sql import functions as F

    tracks = table(spark, sf_dir, "part").select(F.count(F.lit(1))).scalar()
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("listener"), F.col("o_orderkey").alias("pos"),
        (F.col("o_orderkey") * 7 % tracks).alias("track"), F.expr("o_orderkey div 4096").alias("part"))


LISTENER_QUEUE_SQL = ("SELECT o_custkey AS listener, o_orderkey AS pos, o_orderkey * 7 % (SELECT count(*) FROM part) AS track FROM orders")
