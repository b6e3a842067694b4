r"""SpotSigs fingerprints, in built-in expressions only.

Where a common word is followed by a content word, a signature begins: the
common word and the next CHAIN content words, whatever common words stand
between them. A document's fingerprint is the set of its signatures' hashes.
Sets are compared by Jaccard similarity; for a threshold, only sets of nearby
lengths can pass, so documents are partitioned by length, and a pair is built
only if it shares one of the signatures that a passing pair must share.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fluxweave.llm.tables import stored, table

# common words of English, German, French and Spanish
COMMON = (
    "a an and are as at be by for from has have he in is it of on or that the this to was were when which will with you "
    "als auf das dem den der des die ein eine einer für im in ist mit nicht sich sie und von zu "
    "au aux avec ce dans de des du elle en est et il la le les ne pas par pour que qui se sur un une "
    "al como con de del el en es la las lo los no para por que se su un una y"
)
CHAIN = 2
NO_WORD = r"[\x00-/:-@\[-`{-\x7f]+"
ROWS_PER_CHUNK = 256


def _any_of(words: list[str]) -> str:
    """A pattern for any of the words that tells them apart letter by letter."""
    heads = sorted({w[0] for w in words if w})
    parts = []
    for head in heads:
        tails = [w[1:] for w in words if w.startswith(head)]
        parts.append(head + (_any_of([t for t in tails if t]) + ("?" if "" in tails else "") if any(tails) else ""))
    return f"(?:{'|'.join(parts)})"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, wherever and however often ``use`` has it, inner loops included."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def signatures(text: Column, common: str = COMMON, chain: int = CHAIN) -> Column:
    """Sorted set of 32-bit signature hashes; null text counts as empty.

    Words are runs of characters other than ASCII spaces, marks and controls, in
    lower case. A text with words but no whole chain has one signature, its
    words; one without words has none.
    """
    any_ = _any_of(common.split())
    norm = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NO_WORD, " ")), F.lit(" "))

    def spots(words: Column) -> Column:
        """Texts from the last common word of a run up to the next run; first what comes before any."""
        parts = F.split(F.regexp_replace(words, rf" ({any_} )++(?=[^ ])", "\n$1"), "\n")
        return _once(parts, lambda p: F.concat(F.slice(p, F.lit(1), F.size(p) - 1), F.array(F.regexp_replace(F.element_at(p, -1), rf"(?: {any_})*+ $", ""))))

    def chains(parts: Column) -> Column:
        def chained(spot: Column, i: Column) -> Column:
            after = [F.get(parts, i + k) for k in range(1, chain)]
            content = [F.coalesce(F.substr(s, F.locate(" ", s)), F.lit("")) for s in after]
            own = F.substring_index(spot, " ", chain + 1)
            longer = F.substring_index(F.concat(spot, *content), " ", chain + 1)
            return F.when(F.octet_length(own) < F.octet_length(spot), own).otherwise(longer)

        # every spot has a content word, so only the last spots can fall short of a chain
        sure = F.size(parts) - chain
        enough = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "))) == chain
        whole = F.filter(F.transform(parts, chained), lambda s, i: (i > 0) & ((i <= sure) | enough(s)))
        return F.sort_array(F.array_distinct(F.transform(whole, lambda s: F.hash(s))))

    def chosen(words: Column) -> Column:
        found = _once(_once(spots(words), chains), lambda sigs: F.when(F.size(sigs) > 0, sigs).otherwise(F.array(F.hash(words))))
        return F.when(words == "  ", F.array().cast("array<int>")).otherwise(found)

    return _once(norm, chosen)


def fingerprint(sigs: Column) -> Column:
    """The set as text: eight hexadecimal digits for each signature."""
    return F.array_join(F.transform(sigs, lambda s: F.lower(F.lpad(F.hex(s.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets, 1 if both are empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(common / (F.size(a) + F.size(b) - common))


def members(docs: DataFrame) -> DataFrame:
    """(doc_id, representative) of every document that has signatures: the smallest doc_id with an equal set, which stands for it in ``near_pairs``."""
    sets = docs.filter("doc_id IS NOT NULL").select("doc_id", signatures(F.col("text")).alias("sigs")).filter(F.size("sigs") > 0)
    sets = stored(sets, "spot-members")
    first = sets.groupBy("sigs").agg(F.min("doc_id").alias("representative"))
    return sets.join(first, "sigs").select("doc_id", "representative").distinct()


def near_pairs(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(a, b, likeness): pairs of documents, a < b, whose signature sets have a likeness of at least ``threshold``.

    Documents with equal sets are one, named by the smallest doc_id; ``members``
    has the others. Documents that share a rare signature meet in pairs, so a
    group of n edited copies makes n * n rows. A set of n
    signatures is of length class floor(log(n) / log(1 / threshold)); the
    shorter of a passing pair is in the longer one's class or the one below, so
    every set also visits the class above. Of a set's signatures, rarest first,
    a passing pair must share one of the first n - ceil(threshold * n) + 1.
    Documents without signatures or doc_id are in no pair.
    """
    sets = docs.filter("doc_id IS NOT NULL").select("doc_id", signatures(F.col("text")).alias("sigs")).filter(F.size("sigs") > 0)
    sets = stored(sets.groupBy("sigs").agg(F.min("doc_id").alias("doc_id")), "spot-sets")
    each = sets.select("doc_id", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    often = each.groupBy("sig").agg(F.count(F.lit(1)).alias("df"))
    rare = each.join(often, "sig").groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "sig"))).alias("order"))
    first = F.slice("order", F.lit(1), (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int"))
    size_class = F.floor(F.log("n") / -math.log(threshold) + 1e-9)
    keyed = rare.select("doc_id", "n", size_class.alias("class"), F.explode(F.transform(first, lambda x: x["sig"])).alias("sig"))
    longer = keyed.select(F.col("doc_id").alias("x"), F.col("n").alias("nx"), "class", "sig")
    shorter = keyed.unionByName(keyed.withColumn("class", F.col("class") + 1)).select(F.col("doc_id").alias("y"), F.col("n").alias("ny"), "class", "sig")
    fits = ((F.col("ny") < F.col("nx")) | ((F.col("ny") == F.col("nx")) & (F.col("y") < F.col("x")))) & (F.col("ny") >= F.col("nx") * threshold - 1e-9)
    met = longer.join(shorter, ["class", "sig"]).filter(fits).select("x", "y").distinct()
    left = sets.select(F.col("doc_id").alias("x"), F.col("sigs").alias("sx"))
    right = sets.select(F.col("doc_id").alias("y"), F.col("sigs").alias("sy"))
    judged = met.join(left, "x").join(right, "y").withColumn("likeness", likeness(F.col("sx"), F.col("sy")))
    return judged.filter(F.col("likeness") >= threshold - 1e-12).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "likeness")


def _lower_key(keys: DataFrame, group: int = 4096) -> DataFrame:
    """(chunk, below) for distinct whole numbers: the next smaller one, null for the smallest.

    The window runs in groups of ``group`` numbers; only the largest of each group are ordered together.
    """
    cut = keys.withColumn("__group", F.floor(F.col("chunk") / group))
    tops = cut.groupBy("__group").agg(F.max("chunk").alias("__top"))
    below = tops.select("__group", F.lag("__top").over(Window.orderBy("__group")).alias("__carry"))
    inside = cut.withColumn("__lag", F.lag("chunk").over(Window.partitionBy("__group").orderBy("chunk")))
    return inside.join(below, "__group").select("chunk", F.coalesce("__lag", "__carry").alias("below"))


def with_next(docs: DataFrame, columns: list[str], more: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``docs`` with ``next``, a struct of ``columns`` of the following document by descending doc_id, the first one after the last.

    Equal ids follow their texts; a null id comes after all others. Documents
    are cut into chunks of about ROWS_PER_CHUNK by id, and every chunk is given
    the first document of the next one, so nothing orders the whole table.
    ``more`` adds columns to every row once, after the rows are put together.
    """
    stats = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
    low, high, n = (int(x or 0) for x in stats)
    width = max(1, (high - low + 1) * ROWS_PER_CHUNK // max(n, 1))
    largest = -1 if stats[1] is None else (high - low) // width
    keyed = docs.withColumn("__key", F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit(low - 1).cast("decimal(20,0)")))
    keyed = keyed.withColumn("__chunk", F.floor((F.col("__key") - F.lit(low).cast("decimal(20,0)")) / width).cast("long"))
    ends = keyed.groupBy(F.col("__chunk").alias("chunk")).agg(F.max("__key").alias("__top"))
    ends = stored(ends, "chunk-ends")
    above = _lower_key(ends.select("chunk")).withColumnRenamed("below", "__below")
    # the chunk that follows a chunk is the one below it; the largest follows the smallest
    follows = above.select("chunk", F.coalesce("__below", F.lit(largest).cast("long")).alias("__next"))
    tops = ends.select(F.col("chunk").alias("__next"), "__top")
    guests = follows.join(tops, "__next").select(F.col("chunk").alias("__to"), F.col("__top").alias("__key"))
    small = guests.count() <= 1_000_000
    visits = keyed.join(F.broadcast(guests) if small else guests, "__key").withColumn("__chunk", F.col("__to")).drop("__to")
    both = keyed.withColumn("__guest", F.lit(0)).unionByName(visits.withColumn("__guest", F.lit(1)))
    order = Window.partitionBy("__chunk").orderBy("__guest", F.desc("__key"), "text")
    following = F.lead(F.struct(*columns)).over(order)
    both = more(both)
    return both.select("*", following.alias("next")).filter("__guest = 0").drop("__key", "__chunk", "__guest")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of every text, of its edited text, and how near they and the next document's are.

    The edited text has its last floor(n / 2) of n code points replaced by the
    first as many of the next document (by descending doc_id, see ``with_next``).
    Null text counts as empty; columns other than doc_id and text are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select("doc_id", text.alias("text"))
    n = F.length("text")
    edited = F.concat(F.substr(F.col("text"), F.lit(1), n - F.floor(n / 2).cast("int")), F.substr(F.col("next.text"), F.lit(1), F.floor(n / 2).cast("int")))
    told = with_next(read, ["text", "sigs"], lambda df: df.withColumn("sigs", signatures(F.col("text")))).select("doc_id", n.cast("long").alias("n_chars"), "sigs", edited.alias("edited"), F.col("next.sigs").alias("next_sigs"))
    told = told.withColumn("edited_sigs", signatures(F.col("edited")))
    return told.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def op1_spotsigs(spark, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
