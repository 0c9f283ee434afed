"""Benchmark decontamination by template windows, with DataFrame operations only.

Texts become templates: digits become '#', a unit after a number becomes '<unit>', a capitalised word after another
word becomes '<name>', all else is lower-cased and stripped of punctuation. Windows of eight template tokens are hashed
and joined to the benchmark's windows. A document leaks an item if six or more windows of the item (all, if it has
fewer) stand in it at one offset, thirteen tokens in a row for instance, and the slots are filled consistently there: what
the item has in two slots alike, the document has alike too.

Windows are exploded with nothing but a row key, their place and their slots' values, and meet the benchmark's windows in
a join that is a broadcast only if the benchmark has at most ``broadcast_rows`` windows (counted first); beyond, Spark
plans the join by size. Only hits are shuffled then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.llm.common import stored

WINDOW = 8
MATCHES = 6
LITERALS = 4
BROADCAST_ROWS = 1_000_000
# Units that may follow a number.
UNITS = "km m cm mm kg g mg l ml s ms h min km/h mph mi ft in lb oz kwh w v usd eur gbp percent hours hour minutes minute seconds second days day weeks week months month years year miles mile meters meter metres metre kilometers kilometer kilometres kilometre centimeters centimeter grams gram kilograms kilogram liters liter litres litre feet foot inches inch pounds pound dollars dollar cents cent euros euro degrees degree".split()
#: A letter that marks names until the windows are cut.
MARK = "ꞏ"
NAME = r"([\p{L}\p{N}][,;:]? )(\p{Lu}\p{Ll}+)"
UNIT = "# (" + "|".join(sorted((u for u in UNITS if u.isalpha()), key=lambda u: (-len(u), u))) + ")( |$)"


def templates(texts: DataFrame, keys: list[str], names: bool = True) -> DataFrame:
    """keys, raw (lower-case words) and template (the same places as one text) of texts' column text.

    Names are marked in two rounds, as the first can't see names that follow one another. names: whether they are slots
    in the template, or ordinary words. Each step is a column of its own, so that none is worked out more than once.
    """
    has = lambda c, x: F.contains(F.col(c), F.lit(x))
    cut = texts.select(*keys, F.regexp_replace(F.col("text").cast("string"), NAME, f"$1{MARK}$2").alias("once"))
    cut = cut.select(*keys, F.when(has("once", MARK), F.regexp_replace("once", NAME, f"$1{MARK}$2")).otherwise(F.col("once")).alias("marked"))
    cut = cut.select(*keys, F.lower(F.trim(F.regexp_replace("marked", r"[^\p{L}\p{N}]+", " "))).alias("words"))
    named = F.regexp_replace("words", MARK + r"[\p{L}\p{N}]+", "<name>") if names else F.replace(F.col("words"), F.lit(MARK), F.lit(""))
    cut = cut.select(*keys, "words", F.when(has("words", MARK), named).otherwise(F.col("words")).alias("named"))
    cut = cut.select(*keys, "words", F.regexp_replace("named", r"\p{N}+", "#").alias("numbered"))
    template = F.when(has("numbered", "#"), F.regexp_replace("numbered", UNIT, "# <unit>$2")).otherwise(F.col("numbered"))
    return cut.select(*keys, F.split("words", " ").alias("raw"), template.alias("template"))


def windows(texts: DataFrame, keys: list[str], names: bool = True, window: int = WINDOW, exact: tuple[int, ...] = ()) -> DataFrame:
    """keys, pos, h, slots, n_windows of every window of texts' column text; slots: the words in the slots, else blanks.

    exact: numbers of words; the rows then have size and n_tokens too, and besides the template windows (size 0) there are
    all windows of so many words as they are, whose h is that of the words and whose slots are empty.

    A window's hash is built from those of its halves: one round for each doubling, and a last one of two halves that
    overlap if the length is no power of two. Short texts have no windows; a filter on their length would be pushed
    below the regular expressions and repeat them.
    """
    cut = templates(texts, keys, names)
    cut = cut.select(*keys, "raw", F.split("template", " ").alias("tokens"), (F.contains("template", F.lit("#")) | F.contains("template", F.lit("<"))).alias("slotted"))
    cut = cut.withColumn("n_windows", F.greatest(F.size("tokens") - (window - 1), F.lit(0)))
    cut = cut.withColumn("h", F.transform("tokens", lambda t: F.xxhash64(t)))
    size = 1
    while size < window:
        step = min(size, window - size)
        cut = cut.withColumn("h", F.zip_with("h", F.slice("h", F.lit(step + 1), F.size("h")), lambda a, b: F.xxhash64(a, b)))  # past the last window: hashes of nulls
        size += step
    slots = F.transform(F.sequence(F.lit(1), F.col("n_windows")), lambda i: F.array_join(F.zip_with(F.slice("tokens", i, window), F.slice("raw", i, window), lambda t, r: F.when(F.contains(t, F.lit("#")) | F.contains(t, F.lit("<")), r).otherwise("")), " "))
    cut = cut.withColumn("slots", F.when(F.col("slotted") & (F.col("n_windows") > 0), slots).otherwise(F.array().cast("array<string>")))
    each = F.zip_with(F.slice("h", F.lit(1), F.col("n_windows")), "slots", lambda h, s: F.struct(h.alias("h"), F.coalesce(s, F.lit("")).alias("slots")))
    if not exact:
        return cut.select(*keys, "n_windows", F.posexplode(each).alias("pos", "w")).select(*keys, "pos", "w.*", "n_windows")
    pair = lambda e, step: F.zip_with(e, F.slice(e, F.lit(step + 1), F.size(e)), lambda a, b: F.xxhash64(a, b))
    row = lambda n, i, h, slots: F.struct(F.lit(n).alias("size"), i.alias("pos"), h.alias("h"), slots.alias("slots"))
    cut = cut.withColumn("n_tokens", F.size("raw")).withColumn("each", F.transform(each, lambda w, i: row(0, i, w["h"], w["slots"])))
    cut = cut.withColumn("e1", F.transform("raw", lambda r: F.xxhash64(F.replace(r, F.lit(MARK), F.lit("")))))
    size = 1
    while 2 * size <= max(exact):
        cut = cut.withColumn(f"e{2 * size}", pair(f"e{size}", size))
        size *= 2
    parts = [F.col("each")]
    for n in exact:
        half = 1 << n.bit_length() - 1
        h = F.col(f"e{half}") if half == n else pair(f"e{half}", n - half)
        parts.append(F.transform(F.slice(h, F.lit(1), F.greatest(F.col("n_tokens") - (n - 1), F.lit(0))), lambda x, i: row(n, i, x, F.lit(""))))
    return cut.select(*keys, "n_windows", "n_tokens", F.explode(F.concat(*parts)).alias("w")).select(*keys, "w.*", "n_windows", "n_tokens")


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, literals: int = LITERALS) -> DataFrame:
    """(h, item_id, item_pos, item_slots, item_windows); windows of fewer ordinary words than literals are no evidence."""
    items = benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select("item_id", F.col("text"))
    both = windows(items, ["item_id"], True, window).withColumn("named", F.lit(1)).unionAll(windows(items, ["item_id"], False, window).withColumn("named", F.lit(0)))
    blank = F.size(F.filter(F.split("slots", " "), lambda x: x != ""))
    kept = both.where(F.lit(window) - blank >= literals)
    kept = kept.groupBy("h", "item_id", "pos").agg(F.max(F.struct("named", "slots", "n_windows")).alias("x"))
    return kept.select("h", "item_id", F.col("pos").alias("item_pos"), F.col("x.slots").alias("item_slots"), F.col("x.n_windows").alias("item_windows"))


def leaks(texts: DataFrame, benchmark: DataFrame, window: int = WINDOW, matches: int = MATCHES, literals: int = LITERALS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(row_key, item_id, n_matched): the items that each row of texts (row_key, text) leaks."""
    bench = benchmark_windows(benchmark, window, literals)
    small = len(bench.limit(broadcast_rows + 1).select(F.lit(1).alias("x")).groupBy().count().where(F.col("count") <= broadcast_rows).head(1)) > 0
    hits = windows(texts, ["row_key"], True, window).select("row_key", "pos", "h", "slots").join(F.broadcast(bench) if small else bench, "h")
    hits = hits.withColumn("offset", F.col("pos") - F.col("item_pos"))
    place = ["row_key", "item_id", "offset"]
    # one row per window and one per slot value, so that both questions take one shuffle of the hits
    pairs = F.filter(F.arrays_zip(F.split("item_slots", " ").alias("a"), F.split("slots", " ").alias("b")), lambda p: p["a"] != "")
    told = F.concat(F.array(F.struct(F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b"))), pairs)
    rows = hits.select(*place, "item_pos", "item_windows", F.explode(told).alias("p"))
    values = rows.groupBy(*place, F.col("p.a").alias("slot"), F.when(F.col("p.a").isNull(), F.col("item_pos")).alias("at")).agg(F.min("p.b").alias("low"), F.max("p.b").alias("high"), F.max("item_windows").alias("item_windows"))
    found = values.groupBy(*place).agg(F.count_if(F.col("slot").isNull()).alias("n_matched"), F.max("item_windows").alias("item_windows"), F.bool_or(F.coalesce(F.col("low") != F.col("high"), F.lit(False))).alias("mixed"))
    kept = found.where((F.col("n_matched") >= F.least(F.lit(matches), F.col("item_windows"))) & ~F.col("mixed"))
    return kept.groupBy("row_key", "item_id").agg(F.max("n_matched").alias("n_matched"))


def whole_benchmark_windows(benchmark: DataFrame, window: int = WINDOW, literals: int = LITERALS) -> DataFrame:
    """(h, size, item_id, item_key, item_pos, item_slots, tier, n_named, n_any, n_all): every window of every item.

    A place whose template has at least ``literals`` ordinary words is asked for by template (size 0; tier 2, or 1 if that
    holds only with names as ordinary words). A place whose template with names has fewer is asked for by its words (size
    ``window``, tier 0), and an item of fewer words than ``window`` by all of its words. n_named, n_any and n_all count
    an item's places of tier 2, of tier 1 and 2, and all. Different texts of one item_id are items of their own.
    """
    keys = ["item_id", "item_key"]
    items = benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select("item_id", F.col("text").cast("string").alias("text")).distinct()
    items = items.withColumn("item_key", F.xxhash64("text"))
    named = windows(items, keys, True, window, tuple(range(1, window + 1)))
    whole = (F.col("size") == window) | (F.col("n_windows") == 0) & (F.col("size") == F.col("n_tokens")) & (F.col("h") != F.xxhash64(F.lit("")))
    named = named.where((F.col("size") == 0) | whole).withColumn("kind", F.when(F.col("size") == 0, 2).otherwise(0))
    columns = [*keys, "pos", "h", "size", "slots", "n_windows", "kind"]
    both = named.select(*columns).unionAll(windows(items, keys, False, window).withColumn("size", F.lit(0)).withColumn("kind", F.lit(1)).select(*columns))
    enough = F.lit(window) - F.size(F.filter(F.split("slots", " "), lambda x: x != "")) >= literals
    spot = Window.partitionBy(*keys, "pos")
    both = both.withColumn("by_name", F.max((F.col("kind") == 2) & enough).over(spot)).withColumn("own", F.max(F.when(F.col("kind") == 2, F.col("slots"))).over(spot))
    kept = both.where(F.when(F.col("kind") == 0, ~F.col("by_name")).otherwise(enough))
    kept = kept.withColumn("tier", F.when(F.col("kind") == 0, 0).when(F.col("by_name"), 2).otherwise(1)).withColumn("slots", F.when(F.col("kind") == 0, F.coalesce("own", F.lit(""))).otherwise(F.col("slots")))
    kept = kept.groupBy(*keys, "pos", "h", "size").agg(F.max(F.struct("kind", "tier", "slots", "n_windows")).alias("x")).select(*keys, "pos", "h", "size", "x.*")
    places = lambda tier: F.count_distinct(F.when(F.col("tier") >= tier, F.col("pos")))
    sizes = kept.groupBy(*keys).agg(places(2).alias("n_named"), places(1).alias("n_any"), F.greatest(F.max("n_windows"), F.lit(1)).alias("n_all"))
    return kept.join(sizes, keys).select("h", "size", *keys, F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"), "tier", "n_named", "n_any", "n_all")


def whole_leaks(texts: DataFrame, benchmark: DataFrame, window: int = WINDOW, matches: int = MATCHES, literals: int = LITERALS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """leaks() without its blind spots: (row_key, item_id, n_matched).

    Windows of few ordinary words and items of fewer tokens than a window are looked for word by word. An item is leaked
    if ``matches`` of its windows, or all if it has fewer, stand at one offset; with numbers or names changed, only the
    windows that a template can find are asked for. Those windows are either neighbours among the ones found at the
    offset, with slots filled consistently, or have the item's own words in all slots, wherever at the offset they are.
    """
    bench = stored(whole_benchmark_windows(benchmark, window, literals), "leak-windows")
    small = bench.limit(broadcast_rows + 1).count() <= broadcast_rows
    exact = tuple(sorted(r["size"] for r in bench.where("size > 0").select("size").distinct().collect()))
    docs = windows(texts, ["row_key"], True, window, exact)
    if not exact:
        docs = docs.withColumn("size", F.lit(0))
    hits = docs.select("row_key", "pos", "h", "slots", *["size"] * bool(exact)).join(F.broadcast(bench) if small else bench, ["h", "size"] if exact else "h")
    place = ["row_key", "item_id", "item_key", "offset"]
    told = F.struct("tier", "item_slots", F.when(F.col("size") > 0, F.col("item_slots")).otherwise(F.col("slots")).alias("slots"))
    hits = hits.withColumn("offset", F.col("pos") - F.col("item_pos")).select(*place, "item_pos", "n_named", "n_any", "n_all", told.alias("x")).repartition(*place)
    one = hits.groupBy(*place, "item_pos").agg(F.max("x").alias("x"), *[F.max(c).alias(c) for c in ("n_named", "n_any", "n_all")])
    # windows in a row agree from behind the last one in which a slot had another value; told by running counts
    run = Window.partitionBy(*place).orderBy("item_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kinds = {"named": 2, "any": 1, "all": 0}
    count = lambda what: [F.sum(F.when(what & (F.col("x.tier") >= t), 1).otherwise(0)).over(run).alias(c) for c, t in kinds.items()]
    one = one.select("*", F.struct("item_pos", *count(F.lit(True))).alias("here"), F.struct(*count(F.col("x.item_slots") == F.col("x.slots"))).alias("own"))
    pairs = F.filter(F.arrays_zip(F.split("x.item_slots", " ").alias("a"), F.split("x.slots", " ").alias("b")), lambda p: p["a"] != "")
    pairs = F.concat(F.array(F.struct(F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b"))), pairs)
    sizes = [f"n_{c}" for c in kinds]
    rows = one.select(*place, "item_pos", "here", "own", *sizes, F.posexplode(pairs).alias("k", "p")).select("*", "p.a", "p.b").drop("p")
    same = Window.partitionBy(*place, "a").orderBy("item_pos", "k")
    rows = rows.withColumn("last", F.lag(F.struct("b", "here")).over(same)).withColumn("other", F.when(F.col("last.b") != F.col("b"), F.col("last.here")))
    rows = rows.withColumn("other", F.max("other").over(same.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ends = rows.groupBy(*place, "item_pos").agg(F.max("other").alias("other"), *[F.max(c).alias(c) for c in ("here", "own", *sizes)]).withColumn("other", F.max("other").over(run))
    enough = lambda n: F.greatest(*[F.when((F.col(f"n_{c}") > 0) & (n(c) >= F.least(F.lit(matches), F.col(f"n_{c}"))), n("all")).otherwise(0) for c in kinds])
    agreed, own = enough(lambda c: F.col(f"here.{c}") - F.coalesce(F.col(f"other.{c}"), F.lit(0))), enough(lambda c: F.col(f"own.{c}"))
    found = ends.groupBy("row_key", "item_id").agg(F.max(F.greatest(agreed, own)).alias("n_matched"))
    return found.where("n_matched > 0")


def row_key(docs: DataFrame) -> Column:
    """The same for rows of the same doc_id and text alone: 128 bits of hashes, as 64 would meet by chance among 10^10 rows."""
    return F.struct(F.xxhash64(docs["doc_id"], docs["text"]).alias("a"), F.xxhash64(F.lit(1), docs["text"], docs["doc_id"]).alias("b"))


def contamination(docs: DataFrame, benchmark: DataFrame, whole: bool = False, **options) -> DataFrame:
    """(doc_id, contaminated, item_id, n_items, n_matched), one row per row of docs.

    item_id is the smallest item that the row leaks, n_matched its most matched windows at one offset; null and 0 if it
    leaks none. whole: by whole_leaks(), as the queries do; else by the narrower rule of contamination_sql(), by which
    texts and items of fewer than eight tokens leak nothing. Null and empty texts leak nothing. Repeated rows are
    judged alike; null ids are judged by their texts. An empty benchmark clears every document.
    """
    keyed = docs.select("doc_id", "text", row_key(docs).alias("row_key"))
    found = (whole_leaks if whole else leaks)(keyed.select("row_key", "text"), benchmark, **options)
    best = found.groupBy("row_key").agg(F.min(F.struct("item_id", "n_matched")).alias("x"), F.count("*").alias("n_items"))
    out = keyed.select("doc_id", "row_key").join(best, "row_key", "left")
    return out.select("doc_id", F.col("x").isNotNull().alias("contaminated"), F.col("x.item_id").alias("item_id"), F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"), F.coalesce("x.n_matched", F.lit(0)).cast("bigint").alias("n_matched"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, whole: bool = False, **options) -> DataFrame:
    """docs without the rows that leak an item of the benchmark; whole as in contamination()."""
    keyed = docs.select("text", row_key(docs).alias("row_key"))
    found = (whole_leaks if whole else leaks)(keyed, benchmark, **options).select(F.col("row_key").alias("leaking_row_key")).distinct()
    return docs.join(found, row_key(docs) == found["leaking_row_key"], "left_anti")


def contamination_sql(docs: str = "documents", benchmark: str = "benchmark", window: int = WINDOW, matches: int = MATCHES, literals: int = LITERALS) -> str:
    """DuckDB SQL for contamination(), with the windows' words in place of their hashes."""
    name, unit = NAME.replace("'", "''"), UNIT.replace("'", "''")
    words = lambda t: f"lower(trim(regexp_replace(regexp_replace(regexp_replace({t}, '{name}', '\\1{MARK}\\2', 'g'), '{name}', '\\1{MARK}\\2', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')))"
    slotted = lambda named: f"regexp_replace(w, '{MARK}[\\p{{L}}\\p{{N}}]+', '<name>', 'g')" if named else f"replace(w, '{MARK}', '')"
    template = lambda named: f"regexp_replace(regexp_replace({slotted(named)}, '\\p{{N}}+', '#', 'g'), '{unit}', '# <unit>\\2', 'g')"
    cut = lambda key, named, src: f"""SELECT {key}, i AS pos, len(tokens) - {window - 1} AS n_windows, array_to_string(tokens[i:i + {window - 1}], ' ') AS h,
        array_to_string(list_transform(range(i, i + {window}), lambda j: CASE WHEN regexp_matches(tokens[j], '[#<]') THEN raw[j] ELSE '' END), ' ') AS slots
        FROM (SELECT {key}, raw, tokens, unnest(range(1, len(tokens) - {window - 2})) AS i FROM (SELECT {key}, string_split(w, ' ') AS raw, string_split({template(named)}, ' ') AS tokens FROM {src}) WHERE len(tokens) >= {window})"""  # noqa: E731
    return f"""
    WITH doc_words AS (SELECT doc_id, {words('text')} AS w FROM {docs}),
    item_words AS (SELECT item_id, {words('text')} AS w FROM {benchmark}),
    doc_windows AS ({cut('doc_id', True, 'doc_words')}),
    both_kinds AS (SELECT 1 AS named, * FROM ({cut('item_id', True, 'item_words')}) UNION ALL SELECT 0, * FROM ({cut('item_id', False, 'item_words')})),
    item_windows AS (
        SELECT h, item_id, pos AS item_pos, arg_max(slots, named) AS item_slots, max(n_windows) AS item_windows FROM both_kinds
        WHERE {window} - len(list_filter(string_split(slots, ' '), lambda x: x <> '')) >= {literals} GROUP BY h, item_id, pos
    ),
    hits AS (SELECT doc_id, item_id, pos - item_pos AS o, item_pos, item_windows, item_slots, slots FROM doc_windows JOIN item_windows USING (h)),
    runs AS (SELECT doc_id, item_id, o, count(DISTINCT item_pos) AS n_matched, max(item_windows) AS item_windows FROM hits GROUP BY ALL),
    fills AS (SELECT doc_id, item_id, o, unnest(string_split(item_slots, ' ')) AS a, unnest(string_split(slots, ' ')) AS b FROM hits),
    mixed AS (SELECT DISTINCT doc_id, item_id, o FROM (SELECT doc_id, item_id, o, a FROM fills WHERE a <> '' GROUP BY ALL HAVING min(b) <> max(b))),
    kept AS (SELECT doc_id, item_id, max(n_matched) AS n_matched FROM runs ANTI JOIN mixed USING (doc_id, item_id, o) WHERE n_matched >= least({matches}, item_windows) GROUP BY ALL),
    best AS (SELECT doc_id, min(item_id) AS item_id, arg_min(n_matched, item_id) AS n_matched, count(*) AS n_items FROM kept GROUP BY doc_id)
    SELECT d.doc_id, b.doc_id IS NOT NULL AS contaminated, b.item_id, coalesce(b.n_items, 0)::BIGINT AS n_items, coalesce(b.n_matched, 0)::BIGINT AS n_matched
    FROM {docs} d LEFT JOIN best b USING (doc_id)
    """
