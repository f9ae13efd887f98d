"""Playlist lines, segment tables and byte ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segue import rules
from segue.functions import urls as U
from segue.functions.fold import fold_from
from segue.functions.ordered import Running, SinceReset, scan
from segue.operators.urls import validate_playback_targets
from segue.session import cut_lineage


def playlist_lines(df: DataFrame, playlist: str = "playlist", text: str = "text") -> DataFrame:
    """Playlist texts to lines, ready for ``explode_media_playlist``."""
    return df.select(playlist, F.posexplode(F.split(text, "\r?\n")).alias("line_no", "line"))


def tag_attribute(attrs: Column, name: str) -> Column:
    """``NAME="value"`` if that form occurs, else ``NAME=value`` up to a comma."""
    quoted = F.regexp_extract_all(attrs, F.lit(name + '="([^"]*)"'), F.lit(1))
    bare = F.regexp_extract_all(attrs, F.lit(name + "=([^,]*)"), F.lit(1))
    return F.when(attrs.contains(name + '="'), F.get(quoted, F.lit(0))).otherwise(F.get(bare, F.lit(0)))


def _dotless(path: Column) -> Column:
    """Path with ``.`` and ``..`` segments folded away."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)

    def step(acc: Column, s: Column) -> Column:
        return (F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1))))
                .when(s == ".", acc).otherwise(F.concat(acc, F.array(s))))

    # the empty first part (leading slash) is the floor of the fold
    folded = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array(F.lit("")), step)
    closed = F.when(last.isin(".", ".."), F.concat(folded, F.array(F.lit("")))).otherwise(folded)
    joined = F.array_join(closed, "/")
    return F.when(joined == "", "/").otherwise(joined)


def base_parts(base: Column) -> Column:
    """Struct(scheme, origin, path, query) of a manifest URL; null if it does not parse."""
    parts = F.struct(U.scheme(base).alias("scheme"), F.concat(
        U.scheme(base), F.lit("://"), F.regexp_extract(base, r"^[^:]+://([^/?#]*)", 1)).alias("origin"),
        U.path(base).alias("path"), U.query(base).alias("query"))
    return F.when(U.host(base).isNotNull(), parts)


def join_url(parts: Column, child: Column) -> Column:
    """Absolute form of ``child`` against the parts of its base URL."""
    tail = F.regexp_extract(child, r"^[^?#]*(.*)$", 1)
    name = F.regexp_extract(child, r"^([^?#]*)", 1)
    folder = F.regexp_replace(parts["path"], "[^/]*$", "")
    base_query = F.when(parts["query"] != "", F.concat(F.lit("?"), parts["query"])).otherwise(F.lit(""))
    joined = (F.when(child.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), child)
              .when(child.startswith("//"), F.concat(parts["scheme"], F.lit(":"), child))
              .when(child.startswith("/"), F.concat(parts["origin"], _dotless(name), tail))
              .when(child.startswith("?"), F.concat(parts["origin"], parts["path"], child))
              .when((child == "") | child.startswith("#"), F.concat(parts["origin"], parts["path"], base_query, child))
              .otherwise(F.concat(parts["origin"], _dotless(F.concat(folder, name)), tail)))
    return F.when(parts.isNotNull(), joined)


def resolve_url(base: Column, child: Column) -> Column:
    return join_url(base_parts(base), child)


def explode_media_playlist(lines: DataFrame, playlist: str, chunk: list[str], position: str = "line_no",
                           line: str = "line", base: str = "base_url") -> DataFrame:
    """Lines to one ``segment`` row each (with index, key URL and IV), the last ``map``
    row, or a single ``error`` row when any line is invalid."""
    t = F.trim(line)
    kind = (F.when(t.startswith("#EXT-X-KEY:"), "key").when(t.startswith("#EXT-X-MAP:"), "map")
            .when(t.startswith("#EXT-X-MEDIA-SEQUENCE:"), "sequence").when(t.startswith("#"), "tag")
            .otherwise("segment"))
    marked = lines.where(t != "").select(playlist, *chunk, position, base, t.alias("_t"), kind.alias("kind"))
    marked = marked.where(F.col("kind") != "tag")
    text, what = F.col("_t"), F.col("kind")
    method, uri, iv = (tag_attribute(text, n) for n in ("METHOD", "URI", "IV"))
    given = F.regexp_replace(iv, "^0x", "")
    error = (F.when(what == "map", F.when(uri.isNull(), F.lit("missing map URI")))
             .when(what == "key",
                   F.when(method.isNull(), F.lit("missing key method"))
                   .when(method != "AES-128", F.concat(F.lit("unsupported key method: "), method))
                   .when(uri.isNull(), F.lit("missing key URI"))
                   .when(iv.isNotNull() & (F.length(given) != 32), F.lit("invalid IV length"))
                   .when(iv.isNotNull() & ~given.rlike("^[0-9A-Fa-f]{32}$"), F.lit("invalid IV"))))
    # one summary row per playlist decides what survives
    facts = (marked.where(what.isin("key", "map")).withColumn("_err", error).groupBy(playlist)
             .agg(F.min(F.when(F.col("_err").isNotNull(), F.struct(position, "_err"))).alias("_bad"),
                  F.max(F.when(what == "map", F.col(position))).alias("_map")))
    errors = facts.where("_bad is not null").select(
        playlist, F.col(f"_bad.{position}").alias("line_no"), F.lit("error").alias("kind"),
        F.col("_bad._err").alias("error"))
    healthy = marked.join(facts, playlist, "left").where("_bad is null").drop("_bad")

    seq_text = F.regexp_extract(text, "^#EXT-X-MEDIA-SEQUENCE:(.*)$", 1)
    counted = cut_lineage(scan(
        healthy, [playlist], chunk, [position],
        _seq=Running(F.when(what == "sequence", F.coalesce(U.unsigned(seq_text), F.lit(0))), "last"),
        _index=Running((what == "segment").cast("long"), "sum", before=True)))
    default_iv = F.lower(F.lpad(F.hex(F.coalesce(F.col("_seq"), F.lit(0)) + F.col("_index")), 32, "0"))
    context = F.struct(uri.alias("uri"), F.coalesce(F.lower(given), default_iv).alias("iv"))
    keyed = scan(counted, [playlist], chunk, [position], _enc=Running(F.when(what == "key", context), "last"))
    keyed = keyed.withColumn("_base", base_parts(F.col(base)))
    parts = keyed.where((what == "segment") | ((what == "map") & (F.col(position) == F.col("_map")))).select(
        playlist, F.col(position).alias("line_no"), "kind",
        F.when(what == "segment", F.col("_index")).alias("segment_index"),
        join_url(F.col("_base"), F.when(what == "segment", text).otherwise(uri)).alias("url"),
        join_url(F.col("_base"), F.col("_enc.uri")).alias("key_url"), F.col("_enc.iv").alias("iv"))
    return parts.unionByName(errors, allowMissingColumns=True)


def resolve_child_uris(df: DataFrame, provider: str = "provider", base: str = "base_url", child: str = "child",
                       policies=rules.HOST_POLICIES) -> DataFrame:
    """Adds the absolute ``url`` and validates it for the row's provider."""
    return validate_playback_targets(df.withColumn("url", resolve_url(F.col(base), F.trim(child))), provider, "url",
                                     policies)


def recent_links_step(capacity: int):
    """First-in-first-out memory of distinct URLs; a repeat does not move its entry."""

    def step(state: dict, rows) -> list:
        memory = dict.fromkeys(state["urls"])
        fresh = []
        for url in rows["url"]:
            new = url not in memory
            fresh.append(new)
            if new:
                memory[url] = None
                if len(memory) > capacity:
                    del memory[next(iter(memory))]
        state["urls"] = list(memory)
        return fresh

    return step


def dedupe_segments(df: DataFrame, stream: str, chunk: str, order: list[str],
                    capacity: int = rules.SEGMENT_MEMORY) -> DataFrame:
    """Rows whose URL is not among the last ``capacity`` distinct inserted URLs of the stream.

    A stream with at most ``capacity`` distinct URLs never forgets one: its fresh rows are first occurrences, found by
    a map-side ``min``. Only other streams are folded, in pieces between restart points (``_restarts``).
    """
    place = F.struct(chunk, *order)
    firsts = cut_lineage(df.groupBy(stream, "url").agg(F.min(place).alias("_first")))
    wide = firsts.groupBy(stream).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > capacity).select(stream)
    named = firsts.select(F.col(stream).alias("_s"), F.col("url").alias("_u"), "_first")
    same = F.col(stream).eqNullSafe(F.col("_s")) & F.col("url").eqNullSafe(F.col("_u"))
    narrow = df.join(wide, stream, "left_anti").join(named, same)
    first_rows = narrow.where(place == F.col("_first")).select(*df.columns)
    columns = df.columns
    rows = df.join(wide, stream, "left_semi").select(*columns).join(named, same).withColumn("_new", F.col("_first") == place)
    rows = rows.select(*columns, "_first", "_new")
    counted = cut_lineage(scan(rows, [stream], [chunk], order, _c=Running(F.col("_new").cast("long"))))
    starts, states = _restarts(counted, stream, capacity)
    marked = counted.join(starts.select(stream, "_c", F.lit(True).alias("_cut")), [stream, "_c"], "left")
    marked = marked.withColumn("_cut", F.coalesce(F.col("_cut") & F.col("_new"), F.lit(False)).cast("long"))
    pieces = cut_lineage(scan(marked, [stream], [chunk], order, _piece=Running(F.col("_cut"), before=True)).select(*columns, "_piece"))
    flagged = fold_from(pieces, [stream, "_piece"], [chunk, *order], states, recent_links_step(capacity), "_fresh", "boolean")
    return first_rows.unionByName(flagged.where("_fresh").select(*columns))


def _restarts(counted: DataFrame, stream: str, capacity: int) -> tuple[DataFrame, DataFrame]:
    """Where the memory is known whatever was before: (stream, _c), and the start state of every piece (stream, _piece, _in).

    counted(stream, url, _first, _new, _c): ``_c`` numbers the first occurrences so far. Let x be such a number. If no row
    after first occurrence x repeats a URL from before it until ``capacity`` more have come, all that was inserted in between
    are these first occurrences, so they are the memory. A row at number c that repeats the URL of number k rules out every x
    from max(k, c - capacity) to c. What no row rules out is found by a running sum over the ends of these ranges.
    """
    block = 4 * capacity
    numbers = counted.where("_new").select(stream, "url", F.col("_c").alias("_k"))
    seen = counted.where("NOT _new").select(F.col(stream).alias("_s"), F.col("url").alias("_u"), "_c")
    again = seen.join(numbers, F.col(stream).eqNullSafe(F.col("_s")) & F.col("url").eqNullSafe(F.col("_u")))
    ends = again.select(stream, F.explode(F.array(
        F.struct(F.greatest("_k", F.col("_c") - capacity).alias("_x"), F.lit(1).cast("long").alias("_d")),
        F.struct((F.col("_c") + 1).alias("_x"), F.lit(-1).cast("long").alias("_d")))).alias("e")).select(stream, "e.*")
    points = ends.unionByName(numbers.select(stream, F.col("_k").alias("_x"), F.lit(0).cast("long").alias("_d")))
    points = points.groupBy(stream, "_x").agg(F.sum("_d").alias("_d")).withColumn("_b", F.expr(f"_x div {block}"))
    covered = scan(cut_lineage(points), [stream], ["_b"], ["_x"], _over=Running(F.col("_d")))
    last = numbers.groupBy(stream).agg(F.max("_k").alias("_last"))
    free = covered.where("_over = 0").groupBy(stream, "_b").agg(F.min("_x").alias("_x")).join(last, stream)
    free = free.where(F.col("_x") + capacity <= F.col("_last"))
    # piece numbers count the restarts so far; there is one in ``block`` first occurrences at most
    free = cut_lineage(scan(free.withColumn("_far", F.expr("_b div 4096")), [stream], ["_far"], ["_x"], _piece=Running(F.lit(1).cast("long"))))
    near = numbers.select(stream, "url", "_k", F.explode(F.array_distinct(F.array(
        F.expr(f"(_k - 1) div {block}"), F.expr(f"greatest(_k - {capacity}, 0) div {block}")))).alias("_b"))
    kept = near.join(free.select(stream, "_b", "_x", "_piece"), [stream, "_b"]).where((F.col("_k") > F.col("_x")) & (F.col("_k") <= F.col("_x") + capacity))
    urls = kept.groupBy(stream, "_piece").agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", "url"))), lambda m: m["url"]).alias("urls"))
    none = counted.select(stream).distinct().select(stream, F.lit(0).cast("long").alias("_piece"), F.lit('{"urls": []}').alias("_in"))
    states = none.unionByName(urls.select(stream, "_piece", F.to_json(F.struct("urls"), {"ignoreNullFields": "false"}).alias("_in")))
    return free.select(stream, (F.col("_x") + capacity).alias("_c")), states


def detect_stalled_playlists(reloads: DataFrame, stream: str, chunk: list[str], position: str,
                             outcome: str = "outcome", target_us: str = "target_us") -> DataFrame:
    """Per reload: stall counter and next delay, up to the reload that ends the stream.

    ``outcome`` is ``new`` (a new segment), ``none``, ``error`` or ``end``.
    """
    result = F.col(outcome)
    stalled = result.isin("none", "error").cast("long")
    flagged = scan(reloads, [stream], chunk, [position],
                   stalls=SinceReset(result.isin("none", "error").cast("long"), result == "new"))
    stalls = F.col("stalls")
    over = (result == "end") | (stalls > rules.MAX_STALLS)
    flagged = flagged.withColumn("ended", over)
    first = flagged.where("ended").groupBy(stream).agg(F.min(position).alias("_end"))
    wait = F.greatest(F.least(F.col(target_us), F.lit(rules.MAX_RELOAD_US)), F.lit(rules.MIN_RELOAD_US))
    return (flagged.join(first, stream, "left")
            .where(F.col("_end").isNull() | (F.col(position) <= F.col("_end")))
            .select(stream, position, outcome, "stalls", "ended",
                    F.when(~F.col("ended"), wait.cast("long")).alias("next_delay_us")))


def plan_byte_ranges(df: DataFrame, length: str = "length", chunk: str = "chunk", mode: str = "mode") -> DataFrame:
    """One row per chunk offset with the range headers to try, in order."""
    n, c = F.col(length), F.col(chunk)
    starts = F.when(n.isNull(), F.array(F.lit(0).cast("long"))).when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1, c))
    out = df.select("*", F.explode(starts).alias("offset"))
    o = F.col("offset")
    bounded = F.concat(F.lit("bytes="), o, F.lit("-"), F.least(o + c - 1, n - 1))
    opened = F.concat(F.lit("bytes="), o, F.lit("-"))
    single = (F.col(mode) == "query") | (o == 0)
    return (out.withColumn("first_range", F.when(n.isNull() | ~single, opened).otherwise(bounded))
            .withColumn("second_range", F.when(n.isNotNull() & ~single, bounded)))


def reconcile_range_responses(requests: DataFrame, responses: DataFrame, key: str = "id") -> DataFrame:
    """Requests (mode, offset, range) joined with responses (status, content_range,
    content_length); ``accepted`` says whether the body starts where it was asked to."""
    df = requests.join(responses, key)
    start = U.unsigned(F.regexp_extract("content_range", r"^bytes ([^-/]*)", 1))
    bounds = F.regexp_extract_all(F.col("range"), F.lit(r"^(?:bytes=)?(\d+)-(\d+)$"), F.lit(1))
    low = F.get(bounds, F.lit(0)).try_cast("long")
    high = F.regexp_extract("range", r"-(\d+)$", 1).try_cast("long")
    expected = F.when(high >= low, high - low + 1)
    actual = F.col("content_length")
    fits = F.when(expected.isNull() | actual.isNull(), True).otherwise((actual > 0) & (actual <= expected))
    accepted = (F.when(F.col("status") == 206, F.coalesce(start == F.col("offset"), F.lit(False)))
                .when((F.col("mode") == "query") & (F.col("status") == 200), (F.col("offset") == 0) | fits)
                .otherwise(F.col("offset") == 0))
    total = U.unsigned(F.regexp_extract("content_range", r"^[^/]*/([^/]*)", 1))
    return df.withColumn("accepted", accepted).withColumn("total", total)


def enforce_size_limits(parts: DataFrame, body: str, length: str = "length", declared: str = "declared",
                        kind: str = "kind") -> DataFrame:
    """One row per body: dropped when the declared or the received size passes the cap."""
    cap = F.when(F.col(kind) == "key", rules.MAX_KEY_BYTES).otherwise(rules.MAX_MEDIA_BYTES)
    # lengths are not negative, so a running sum passes the cap iff the total does
    return (parts.groupBy(body, kind)
            .agg(F.sum(length).alias("received"), F.max(declared).alias("declared"))
            .withColumn("dropped", F.coalesce(F.col("declared") > cap, F.lit(False)) | (F.col("received") > cap)))
