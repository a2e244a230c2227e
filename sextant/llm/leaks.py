"""Evaluation texts inside training texts, found with a distributed positional inverted index.

Pass 1 counts in how many documents each word of the items occurs, as plainly spelled: the counts choose the anchors, and the result
doesn't depend on the choice. For every stretch of ``RUN`` words of an item the two
rarest words are its anchors. Pass 2 posts the anchors of all documents with their positions and stores the postings. The lists are adjusted by the
anchor's offset in the item and intersected: only an alignment of document and item at which both anchors of a stretch
stand survives. Exact matches compare the documents of the surviving alignments word by word; proximity matches come from the stored
postings alone.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm.words import plain_words, words
from sextant.session import cut, keep

#: Words of a passage at least; words of an item repeated at least; length from which wording found in two items is shared wording.
RUN, ENOUGH, SHARED = 8, 20, 13
#: Items are searched for in parts of about this many characters, each known to the driver and to every executor while its turn lasts.
PART_CHARS = 64_000_000
#: Up to this many documents with a surviving alignment are broadcast to the scan of the texts; more are joined by hash.
MAX_BROADCAST_DOCS = 200_000
#: Proximity: an item's rarest words, how many of them a document must have near each other, and how near in multiples of the item's own length.
RAREST, NEAR, WITHIN = 8, 6, 2


def _ends_in_shared(c: Column) -> Column:
    """Words that two lists have in common from the start: their number."""
    n = F.least(F.size("rest"), F.size(c))
    first = F.array_position(F.zip_with(F.slice("rest", 1, n), F.slice(c, 1, n), lambda a, b: a == b), False)
    return F.when(c.isNull(), F.lit(0)).when(first == 0, n).otherwise(first - 1).cast("int")


def item_table(items: DataFrame, item_col: str, item_text: str, run: int = RUN, shared: int = SHARED) -> DataFrame:
    """item, words, theirs, common, chars: the items with what they share with items of other texts. All by joins and windows, no item is collected.

    ``theirs``: for each place the number of words from there on that stand in an item with another text too, 0 where fewer than ``run``. ``common``: the
    places in stretches of at least ``shared`` such words. Stretches that begin with the same ``run`` words are sorted; the most words in common are
    those with the nearest stretch, before or after, of another text. Equal texts are one here.
    """

    def read(batches):
        for b in batches:
            w = [words(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(w, pa.list_(pa.string()))], names=["item", "text", "words"])

    ok = items.where(F.col(item_col).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("text"))
    # of an id that is repeated the last by text
    d = keep(ok.groupBy("item").agg(F.max("text").alias("text")).mapInArrow(read, "item long, text string, words array<string>"))
    texts = d.select("words").distinct().select(F.xxhash64("words").alias("h"), "words")
    at = texts.where(F.size("words") >= run).select("h", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("words") - (run - 1)), lambda i: F.slice("words", i, run))).alias("place", "start"))
    several = at.groupBy("start").agg(F.min("h").alias("a"), F.max("h").alias("b")).where(F.col("a") != F.col("b")).select("start")
    w = Window.partitionBy("start").orderBy("rest", "h")
    # only the places whose first words another text has get the rest of their text
    met = at.join(several, "start", "left_semi").join(texts, "h").withColumn("rest", F.slice("words", F.col("place") + 1, F.size("words"))).drop("words")
    near = met.withColumn("p", F.lag(F.struct("h", "rest")).over(w)).withColumn("n", F.lead(F.struct("h", "rest")).over(w))
    # within a row of stretches of one text, the neighbour of another text is the one before the row's first and behind its last
    other = lambda c: F.when(F.col(c).isNotNull() & (F.col(c + ".h") != F.col("h")), F.col(c + ".rest"))
    near = near.withColumn("p", F.last(other("p"), True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.first(other("n"), True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    met = near.select("h", "place", F.greatest(_ends_in_shared(F.col("p")), _ends_in_shared(F.col("n"))).alias("n")).where(F.col("n") >= run)
    by = met.groupBy("h").agg(F.map_from_entries(F.collect_list(F.struct("place", "n"))).alias("met"))
    out = d.withColumn("h", F.xxhash64("words")).join(by, "h", "left")
    theirs = F.transform(F.sequence(F.lit(0), F.size("words")), lambda i: F.coalesce(F.try_element_at("met", i), F.lit(0)))
    out = out.select("item", "words", F.when(F.col("met").isNull(), F.array().cast("array<int>")).otherwise(theirs).alias("theirs"))
    long = F.filter(F.transform("theirs", lambda n, i: F.struct(i.alias("i"), n.alias("n"))), lambda x: x["n"] >= shared)
    common = F.array_distinct(F.flatten(F.transform(long, lambda x: F.sequence(x["i"], x["i"] + x["n"] - 1))))
    return keep(out.select("item", "words", "theirs", common.alias("common"), (F.length(F.array_join("words", " ")) + 1).alias("chars")))


def anchors(items: dict[int, list[str]], df: dict[str, int], run: int = RUN) -> dict[str, list[tuple[int, int]]]:
    """Word to the (item, place)s at which it is one of the two rarest words of some stretch of ``run`` words. Items shorter than that have none."""
    out = defaultdict(set)
    for i, w in items.items():
        for p in range(len(w) - run + 1):
            for q in sorted(range(p, p + run), key=lambda q: (df.get(w[q], 0), w[q], q))[:2]:
                out[w[q]].add((i, q))
    return {w: sorted(v) for w, v in out.items()}


def rarest(items: dict[int, list[str]], df: dict[str, int], n: int = RAREST) -> dict[int, list[str]]:
    """The ``n`` words of each item that are in the fewest documents."""
    return {i: sorted(set(w), key=lambda x: (df.get(x, 0), x))[:n] for i, w in items.items()}


def aligned_runs(doc: list[str], item: list[str], shift: int, run: int = RUN) -> list[tuple[int, int]]:
    """Maximal stretches [a, b) of at least ``run`` words of the item that stand in the document at ``shift``."""
    out, a = [], None
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    for p in range(lo, hi + 1):
        if p < hi and item[p] == doc[p + shift]:
            a = p if a is None else a
        elif a is not None:
            if p - a >= run:
                out.append((a, p))
            a = None
    return out


class Checker:
    """Counts the repeated words of an item that are its own. Items are (words, theirs, common) as ``item_table`` gives them."""

    def __init__(self, items: dict[int, tuple[list[str], list[int], list[int]]], run: int = RUN):
        self.items, self.run = {i: (w, t, frozenset(c)) for i, (w, t, c) in items.items()}, run

    def count(self, doc: list[str], i: int, shifts) -> int:
        """Distinct places of item i in own passages of the document, without wording shared with other items.

        A passage that stands whole in an item with another text is not its own.
        """
        item, theirs, common = self.items[i]
        got: set[int] = set()
        for s in set(shifts):
            for a, b in aligned_runs(doc, item, s, self.run):
                if not theirs or theirs[a] < b - a:
                    part: list[int] = []
                    for p in range(a, b + 1):
                        if p < b and p not in common:
                            part.append(p)
                        else:
                            got.update(part if len(part) >= self.run else ())
                            part = []
        return len(got)


def nearest_words(positions: list[tuple[int, int]], span: int) -> int:
    """The most distinct words in any ``span`` consecutive places, of (place, word) in any order."""
    best, have, left, hits = 0, defaultdict(int), 0, sorted(positions)
    for place, word in hits:
        have[word] += 1
        while place - hits[left][0] >= span:
            have[hits[left][1]] -= 1
            if not have[hits[left][1]]:
                del have[hits[left][1]]
            left += 1
        best = max(best, len(have))
    return best


class Part:
    """Some of the items, their anchors and rarest words, and the postings of these in all documents."""

    def __init__(self, docs: DataFrame, rows: list):
        self.docs, self.spark = docs, docs.sparkSession
        self.items = {r.item: (list(r.words), list(r.theirs), list(r.common)) for r in rows}
        wanted = {i: w for i, (w, _, _) in self.items.items()}
        vocabulary = self.spark.sparkContext.broadcast(frozenset(w for v in wanted.values() for w in v))

        def frequencies(batches):
            n: dict[str, int] = defaultdict(int)
            for b in batches:
                for t in b.column(0).to_pylist():
                    for w in vocabulary.value & plain_words(t):
                        n[w] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["term", "n"])

        counted = docs.select("text").mapInArrow(frequencies, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
        df = {r.term: r.n for r in counted}
        self.places, self.rare = anchors(wanted, df), rarest(wanted, df)
        # words by number: the postings are small, and so is what the tasks get
        self.number = {w: k for k, w in enumerate(sorted({*self.places, *(w for v in self.rare.values() for w in v)}))}

    def postings(self) -> DataFrame:
        """doc, word, positions of the anchors and rarest words in every document: the positional index, written once."""
        number = self.spark.sparkContext.broadcast(self.number)

        def post(batches):
            get = number.value.get
            for b in batches:
                doc, word, at = [], [], []
                for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    by: dict[int, list[int]] = {}
                    for p, n in enumerate(map(get, words(t))):
                        if n is not None:
                            by.setdefault(n, []).append(p)
                    doc += [k] * len(by)
                    word += by.keys()
                    at += by.values()
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(word, pa.int32()), pa.array(at, pa.list_(pa.int32()))], names=["doc", "word", "positions"])

        return keep(self.docs.mapInArrow(post, "doc long, word int, positions array<int>"))

    def alignments(self, postings: DataFrame, enough: int) -> DataFrame:
        """doc, at (item, shifts): alignments of a document and an item at which two anchors of a stretch stand, if they can hold ``enough`` words.

        A run of an alignment goes at most RUN - 1 words beyond its first and last anchor, since a stretch further out would have anchors of its own.
        The anchors' places are those of this part's items, which is bounded, and are broadcast to the postings; a word with very many postings
        is therefore never grouped, only counted by document, item and offset.
        """
        rows = [(self.number[w], [(i, q) for i, q in at]) for w, at in self.places.items()]
        places = self.spark.createDataFrame(rows, "word int, places array<struct<item: long, place: int>>")
        hits = postings.join(F.broadcast(places), "word").select("doc", F.explode("places").alias("x"), "positions").select("doc", "x.item", "x.place", F.explode("positions").alias("p"))
        aligned = hits.groupBy("doc", "item", (F.col("p") - F.col("place")).alias("shift")).agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("a"), F.max("place").alias("b"))
        aligned = aligned.where((F.col("n") > 2) | (F.col("n") == 2) & (F.col("b") - F.col("a") < RUN))
        item = aligned.groupBy("doc", "item").agg(F.sum(F.col("b") - F.col("a") + 2 * RUN - 1).alias("most"), F.collect_list("shift").alias("shifts")).where(F.col("most") >= enough)
        return keep(item.groupBy("doc").agg(F.collect_list(F.struct("item", "shifts")).alias("at")))

    def exact(self, enough: int) -> DataFrame:
        """doc, item, words: exact matches, word by word in the texts of documents with an alignment."""
        checker = self.spark.sparkContext.broadcast(Checker(self.items))

        def check(batches):
            c = checker.value
            for b in batches:
                out = []
                for k, t, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                    w = words(t)
                    out += [(k, x["item"], n) for x in at if (n := c.count(w, x["item"], x["shifts"])) >= enough]
                yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], (pa.int64(), pa.int64(), pa.int32())[j]) for j in range(3)], names=["doc", "item", "words"])

        cand = self.alignments(self.postings(), enough)
        few = cand.count() <= MAX_BROADCAST_DOCS
        # few documents with an alignment: their ids prune the scan and no text is shuffled but theirs; many: hashing them spares sorting the texts
        d = self.docs.join(F.broadcast(cand.select("doc")), "doc", "left_semi") if few else self.docs
        return d.join(cand.hint("shuffle_hash"), "doc").select("doc", "text", "at").mapInArrow(check, "doc long, item long, words int")

    def near(self, enough: int, within: int) -> DataFrame:
        """doc, item, words: proximity matches, from the stored postings alone."""
        lists = [(self.number[w], i, len(ws), within * len(self.items[i][0])) for i, ws in self.rare.items() for w in ws]
        rare = self.spark.createDataFrame(lists, "word int, item long, of int, span int")

        def measure(batches):
            for b in batches:
                doc, item, at, span = (b.column(i).to_pylist() for i in range(4))
                out = [(k, i, n) for k, i, a, s in zip(doc, item, at, span) if (n := nearest_words([(p, x["word"]) for x in a for p in x["positions"]], s)) >= enough]
                yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], (pa.int64(), pa.int64(), pa.int32())[j]) for j in range(3)], names=["doc", "item", "words"])

        hits = self.postings().join(F.broadcast(rare), "word").groupBy("doc", "item", "span").agg(F.collect_list(F.struct("word", "positions")).alias("at"), F.count_distinct("word").alias("n"))
        return hits.where(F.col("n") >= enough).select("doc", "item", "at", "span").mapInArrow(measure, "doc long, item long, words int")


def _by_parts(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, part_chars: int, find) -> DataFrame:
    """The matches of every part of the items, put together."""
    table = item_table(items, item_col, item_text)
    d = docs.where(F.col(id_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    parts = -(-(table.agg(F.sum("chars")).first()[0] or 1) // part_chars)
    found = None
    for k in range(parts):
        rows = table.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == k).drop("chars").orderBy("item").collect()
        one = find(Part(d, rows))
        one = cut(one) if parts > 1 else one
        found = one if found is None else found.unionByName(one)
    return found.groupBy(F.col("doc").alias(id_col), F.col("item").alias(item_col)).agg(F.max("words").alias("words"))


def leaked_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", enough: int = ENOUGH, part_chars: int = PART_CHARS) -> DataFrame:
    """doc_id, item_id, words: documents that repeat at least ``enough`` words of an item in passages of at least RUN consecutive words.

    Words are those a reader sees (see ``words``). A passage that stands whole in an item with another text does not count, nor do words in stretches of SHARED
    words that several items have. Null and empty texts leak nothing; items with fewer than RUN words can't be found. Rows with a
    null id are left out; repeated items with one id count as the last by text, a repeated id of ``docs`` gives its greatest count. Empty tables give no rows.

    Any number of items: what they share is found by joins over all of them, then they are searched for in parts of about ``part_chars`` characters, each
    with its passes over the documents; the result is the same for any size of part. Of the documents only postings of anchor words are stored and shuffled, then the texts
    of documents with a surviving alignment (with more than MAX_BROADCAST_DOCS of those, all texts are hashed to find them).
    """
    return _by_parts(docs, items, id_col, text_col, item_col, item_text, part_chars, lambda p: p.exact(enough))


def near_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", enough: int = NEAR, within: int = WITHIN, part_chars: int = PART_CHARS) -> DataFrame:
    """doc_id, item_id, words: proximity matches, for passages whose words were changed or moved.

    A document matches if at least ``enough`` of the RAREST words that are in the fewest documents (all its words, if an item has no more) stand in any order within ``within`` times as
    many places as the item has words. ``words`` is the greatest number of them. Dirty rows as in ``leaked_items``; items with fewer than ``enough`` distinct words can't be found.
    """
    return _by_parts(docs, items, id_col, text_col, item_col, item_text, part_chars, lambda p: p.near(enough, within))
