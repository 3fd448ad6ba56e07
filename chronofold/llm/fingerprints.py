"""Document fingerprints: a Merkle tree over sections, paragraphs and their pieces.

A section ends at a blank line, a paragraph at a line's end, and within a
paragraph a piece ends at white space after certain letters or marks, so that a
change moves no boundary but its own. A piece's leaf is 32 bits of its MD5; a
paragraph's node is 64 bits of the MD5 of its leaves, a section's of that of its
paragraphs' nodes, and the root the SHA-256 of the sections' nodes. The SHA-256
of the text stands beside the tree, as white space between pieces and sections
is in no leaf. The fingerprint writes all of it down:

    text:root:node=node=leaf.leaf,node=leaf/node=node=leaf      (pieces by ".", paragraphs by ",", sections by "/")

so that equal text hashes mean equal texts, and nodes that differ at one place,
from the root down, locate edits. The likeness of two fingerprints is 1 for equal
texts, else the share of leaves in common (Dice).

All of it is Spark expressions. Pairing each document with the next one (by
descending id) moves every text once: ids are cut into buckets at quantiles, a
bucket's rows are sorted, and the first row of a bucket also goes, as a guest, to
the bucket before it. Quantiles and bucket heads are a number a bucket.

Edge cases: a null text is the empty one; two empty texts are alike by 1, an
empty and another one by 0. Null ids come after all others. Rows with one id
are ordered by their texts, or by a hash of them first where an id fills a whole
bucket, as then it fills several. With one row the next document is that row itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Ranges, literal, text_rank

#: Letters and marks after which white space ends a piece.
ENDINGS = r"nrkxzNRKXZ0-9\p{Punct}"
#: Buckets a shuffle partition, so that partitions get about equally many of them.
SPREAD = 8

SECTION, PARAGRAPH = r"\n[ \t]*\n\s*", r"\n"
#: Digits of a leaf, and of an inner node.
LEAF, NODE = 8, 16
PIECE = rf"(?<=[{ENDINGS}])[ \t]+"


def fingerprint(text: Column) -> Column:
    """The fingerprint of one text."""
    text = F.coalesce(text, F.lit(""))

    def leaf(piece: Column) -> Column:
        return F.substring(F.md5(piece), 1, LEAF)

    def below(line: Column) -> Column:
        return F.array_join(F.transform(F.split(line, PIECE), leaf), ".")

    def nodes(written: Column) -> Column:
        return F.transform(written, lambda x: F.substring(x, 1, NODE))

    def node(of: Column) -> Column:
        return F.substring(F.md5(of), 1, NODE)

    def paragraphs(part: Column) -> Column:
        return F.transform(F.transform(F.split(part, PARAGRAPH), below), lambda p: F.concat(node(p), F.lit("="), p))

    def section(parts: Column) -> Column:
        return F.concat(node(F.array_join(nodes(parts), ",")), F.lit("="), F.array_join(parts, ","))

    def tree(parts: Column) -> Column:
        return F.concat(F.sha2(F.array_join(nodes(parts), "/"), 256), F.lit(":"), F.array_join(parts, "/"))

    whole = F.transform(F.transform(F.split(text, SECTION), paragraphs), section)
    none = F.concat(F.sha2(F.lit(""), 256), F.lit(":"))
    return F.concat(F.sha2(text, 256), F.lit(":"), F.when(text == "", none).otherwise(F.get(F.transform(F.array(whole), tree), F.lit(0))))


def text_sha256(print_: Column) -> Column:
    return F.substring(print_, 1, 64)


def root(print_: Column) -> Column:
    return F.substring(print_, 66, 64)


def _tree(print_: Column) -> Column:
    return F.substring(print_, 131, 1 << 30)


def leaves(print_: Column) -> Column:
    """The distinct leaves."""
    return F.array_distinct(F.filter(F.split(_tree(print_), rf"[.,/]|[0-9a-f]{{{NODE}}}="), lambda x: x != ""))


def sections(print_: Column) -> Column:
    """The sections: node, and the nodes of the paragraphs."""

    def section(written: Column) -> Column:
        below = F.split(F.substring(written, NODE + 2, 1 << 30), ",")
        return F.struct(F.substring(written, 1, NODE).alias("node"), F.transform(below, lambda p: F.substring(p, 1, NODE)).alias("paragraphs"))

    return F.transform(F.split(_tree(print_), "/"), section)


def edits(old: Column, new: Column) -> Column:
    """Places (section, paragraph, from 0) at which the two trees have different nodes, compared from the root down.

    `node` is that of `old` and `other` that of `new`, null where a tree has no such place. None for equal roots, as of
    texts that differ only in white space between pieces or sections. After an inserted paragraph all later ones of its
    section have other places.
    """

    def places(both: Column, i: Column) -> Column:
        none = F.array().cast("array<string>")
        below = F.zip_with(F.coalesce(both["old"]["paragraphs"], none), F.coalesce(both["new"]["paragraphs"], none), lambda p, q: F.struct(p.alias("node"), q.alias("other")))
        each = F.transform(below, lambda x, j: F.struct(i.alias("section"), j.alias("paragraph"), x["node"].alias("node"), x["other"].alias("other")))
        differ = F.filter(each, lambda x: ~x["node"].eqNullSafe(x["other"]))
        return F.when(both["old"]["node"].eqNullSafe(both["new"]["node"]), F.slice(differ, 1, 0)).otherwise(differ)

    pairs = F.zip_with(sections(old), sections(new), lambda s, t: F.struct(s.alias("old"), t.alias("new")))
    differ = F.flatten(F.transform(pairs, places))
    return F.when(root(old) == root(new), F.slice(differ, 1, 0)).otherwise(differ)


def _alike(same_text: Column, a: Column, b: Column) -> Column:
    both = (F.size(a) + F.size(b)).cast("double")
    share = F.coalesce(F.try_divide(2.0 * F.size(F.array_intersect(a, b)), both), F.lit(0.0))
    return F.when(same_text, 1.0).otherwise(share)


def likeness(a: Column, b: Column) -> Column:
    """How alike two fingerprints are, 0 to 1."""
    return _alike(text_sha256(a) == text_sha256(b), leaves(a), leaves(b))


def _dealt(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, rank, text, bucket (a range of ids, from the largest on), guest: each document, and the first of each bucket again as a guest of the bucket before."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ranges = Ranges(rows, "id", SPREAD, F.col("text"))
    rows = rows.withColumn("rank", text_rank(F.col("text")) if ranges.by_text else F.lit(0).cast("bigint"))
    # from the largest ids (0) to the smallest, then null
    known = ranges.count - ranges.nulls
    bucket = F.when(F.col("id").isNull(), ranges.count + known - 1 - ranges.number()).otherwise(known - 1 - ranges.number())

    # the first row of each bucket there is, and the bucket that it visits: the one before, for the very first the last
    heads = rows.groupBy(bucket.alias("bucket")).agg(F.max(F.struct("id", "rank")).alias("first")).orderBy("bucket").collect()
    if not heads:
        return rows.select("id", "rank", "text", F.lit(0).alias("bucket"), F.lit(False).alias("guest")).where(F.lit(False))
    visits = literal([heads[k - 1].bucket for k in range(len(heads))], "array<int>")
    numbers = literal([h.bucket for h in heads], "array<int>")
    ends, ranks = (literal([h.first[c] for h in heads], "array<bigint>") for c in ("id", "rank"))
    place = F.array_position(numbers, F.col("bucket")).cast("int") - 1
    placed = rows.withColumn("bucket", bucket).withColumn("place", place)
    is_head = F.col("id").eqNullSafe(F.get(ends, F.col("place"))) & (F.col("rank") == F.get(ranks, F.col("place")))
    own = F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guest")))
    guest = F.array(F.struct(F.get(visits, F.col("place")).alias("bucket"), F.lit(True).alias("guest")))
    return placed.select("id", "rank", "text", F.explode(F.when(is_head, F.concat(own, guest)).otherwise(own)).alias("to")).select("id", "rank", "text", "to.*")


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited form (its second half replaced by the next text's beginning), and how alike they are.

    Next is by descending id (after the last one: the first). A text's own tree is built once, where it is dealt to; the
    one before it takes the tree over from there.
    """
    # by bucket before the trees are built, so that the window needs no other exchange and only texts are moved
    d = _dealt(docs, id_col, text_col).repartition("bucket").withColumn("fingerprint", fingerprint(F.col("text")))
    d = d.withColumn("leaves", leaves(F.col("fingerprint")))
    order = Window.partitionBy("bucket").orderBy("guest", F.col("id").desc_nulls_last(), F.col("rank").desc(), "text")
    d = d.withColumns({f"next_{c}": F.lead(c).over(order) for c in ("text", "fingerprint", "leaves")}).where(~F.col("guest"))
    size, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), size - half), F.substring("next_text", F.lit(1), half))
    near_next = _alike(text_sha256(F.col("fingerprint")) == text_sha256(F.col("next_fingerprint")), F.col("leaves"), F.col("next_leaves"))
    d = d.select(
        F.col("id").alias(id_col),
        size.cast("bigint").alias("n_chars"),
        "fingerprint",
        "leaves",
        fingerprint(edited).alias("edited_fingerprint"),
        near_next.alias("near_next"),
    )
    near_edited = _alike(text_sha256(F.col("fingerprint")) == text_sha256(F.col("edited_fingerprint")), F.col("leaves"), leaves(F.col("edited_fingerprint")))
    return d.select(id_col, "n_chars", text_sha256(F.col("edited_fingerprint")).alias("edited_sha256"), "fingerprint", "edited_fingerprint", near_edited.alias("near_edited"), "near_next")
