"""Spelling variants of words, by PartEnum signatures of their letters.

Words are counted over all texts. Two words one edit apart (one code point
inserted, deleted or replaced) have letter multisets that differ in at most two
places: as binary vectors with a place for every letter and repetition, their
Hamming distance is 1 for words of neighbouring lengths and 2 for words of one
length. The letters are parted so that the parts carry like numbers of letters.
At most d of the parts can differ, so every choice of all but d parts gives an
exact signature: the letters of those parts. Words with a distance of at most d
share at least one. The signatures are joined by equality, and what meets is
verified by its true edit distance.

An edit also leaves the first three or the last three code points alone, since
words have seven at least. So every signature is joined once with either end.
Without them, words made of few common syllables meet far too often: of the
374,482 words of the check's small table, 121 million pairs share a
signature of five parts, and 25 million one of four parts with an end.

A word's form is its near word of largest count, if that is ``ratio`` times its
own; its root is where its forms end. Counts grow along forms, so a chain has at
most 19 links, which five doublings of all links cover.

Bounds: counting keeps at most ``FLUSH`` words in a task before it hands them on;
the driver sees one row for each letter; all else is joined and grouped on Spark.
A word has at most some hundred thousand near words, whatever the table's size.

Defined cases: a null text has no words, an empty table gives no rows; a row
without an id counts as if its id were empty text; rows that repeat an id and text
count again; ties go to the smallest word in code-point order; runs of any length
are words; extra columns change nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from zlib import crc32

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.llm.common import map_columns, stored

#: Letters of words (A-Z are lower-cased before), and the shortest word.
LETTERS, SHORTEST = "a-zÀ-ÿ", 7
RUN = re.compile(f"[{LETTERS}]{{{SHORTEST},}}")
#: Of the ids and runs, one in so many loses a code point.
DAMAGED = 31
#: The code points at either end of a word of which one edit leaves one end alone.
END = (SHORTEST - 1) // 2
FLUSH = 400_000
#: Longer words are compared without an edit-distance table, whose time grows with the square of their length.
LONG = 64


def word_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(word, n): words of at least seven code points after the damage, with their places in all texts."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        total: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                lower = text.lower() if text.isascii() else text.encode().lower().decode()
                begin = crc32(f"{'' if doc is None else doc}:".encode())
                for word, n in Counter(RUN.findall(lower)).items():
                    h = crc32(word.encode(), begin)
                    if h % DAMAGED == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < SHORTEST:
                            continue
                    total[word] += n
                if len(total) > FLUSH:
                    yield {"word": list(total), "n": list(total.values())}
                    total = Counter()
        yield {"word": list(total), "n": list(total.values())}

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    return map_columns(rows, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def parted(words: DataFrame, parts: int) -> list[str]:
    """Letters in parts that hold like numbers of letters: the most frequent are dealt out in turn, there and back."""
    seen = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("letter")).groupBy("letter").count()
    order = [r.letter for r in seen.orderBy(F.desc("count"), "letter").collect() if r.letter]  # at most 90 letters
    turns = [*range(parts), *reversed(range(parts))]
    out = [""] * parts
    for i, letter in enumerate(order):
        out[turns[i % (2 * parts)]] += letter
    return out


def signatures(parts: list[str], differ: int, length: Column, sorted_letters: Column, word: Column) -> Column:
    """Hashes of every choice of all but ``differ`` parts, with either end of the word: words that are near share one."""
    out = []
    for number, left_out in enumerate(combinations(parts, differ)):
        letters = F.translate(sorted_letters, "".join(left_out), "")
        out += [F.xxhash64(F.lit(number), length, letters, F.lit(side), end) for side, end in enumerate((F.left(word, F.lit(END)), F.right(word, F.lit(END))))]
    return F.array_distinct(F.array(*out))


def one_edit(a: Column, b: Column, more: int) -> Column:
    """Whether b has one code point replaced (``more`` = 0) or one more (1). Long words are compared from their first
    difference on, which takes time in proportion to their length."""
    differ = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: ~x.eqNullSafe(y))
    at = F.array_position(differ, True).cast("int")
    rest = F.substring(a, at + 1 - more, F.length(a)) == F.substring(b, at + 1, F.length(b))
    return F.when(F.length(b) <= LONG, F.levenshtein(a, b, 1) == 1).otherwise(rest)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): every two words exactly one edit apart, once."""
    length, letters = F.length("word"), F.array_join(F.array_sort(F.split("word", "")), "")
    known = words.select("word", "n", length.alias("length"), letters.alias("letters"))
    four, three = parted(words, 4), parted(words, 3)

    def signed(parts: list[str], differ: int, shift: int, prefix: str) -> DataFrame:
        keys = signatures(parts, differ, F.col("length") + shift, F.col("letters"), F.col("word"))
        return known.select(F.explode(keys).alias("key"), F.col("word").alias(prefix), F.col("n").alias(f"{prefix}_n"))

    a, b = F.col("a"), F.col("b")
    # a letter replaced: two places of the vectors differ
    same = signed(four, 2, 0, "a").join(signed(four, 2, 0, "b"), "key").where((a < b) & one_edit(a, b, 0))
    # a letter more: one place differs
    longer = signed(three, 1, 1, "a").join(signed(three, 1, 0, "b"), "key").where((F.length(a) + 1 == F.length(b)) & one_edit(a, b, 1))
    return same.unionByName(longer).drop("key").distinct()


def group(docs: DataFrame, least: int = 2, ratio: int = 10, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word with at least ``least`` places."""
    words = stored(word_counts(docs, id_column, text_column).where(f"n >= {least}"), "words")
    pairs = stored(near_pairs(words), "near-words")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))
    near = both.groupBy(F.col("a").alias("word"), F.col("a_n").alias("own_n")).agg(
        F.count("*").alias("n_near"), F.max("b_n").alias("most"), F.min(F.struct((-F.col("b_n")).alias("n"), F.col("b").alias("word"))).alias("first"),
    )
    is_form = F.col("most") >= ratio * F.col("own_n")
    near = stored(near.select("word", "n_near", F.when(is_form, F.col("first.word")).alias("form"), F.when(is_form, F.col("most")).alias("form_n")), "forms")
    links = near.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(5):
        on = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = stored(links.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return words.join(near, "word", "left").join(links, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n",
    )


#: The same in SQL: a table of 256 remainders makes the crc32, and near words meet by the texts that a deletion leaves.
GROUP_SQL = r"""
WITH RECURSIVE remainders AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(0, 8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) AS c FROM (
      SELECT unnest(range(0, 256))::BIGINT AS i))),
runs AS (
  SELECT doc_id, run, count(*) AS k FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (
  SELECT run, k, xor(list_reduce(list_transform(range(1, octet_length(encode(doc_id || ':' || run)) + 1),
      lambda p: ('0x' || substr(hex(encode(doc_id || ':' || run)), (2 * p - 1)::INTEGER, 2))::BIGINT),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h FROM runs, remainders),
words AS (
  SELECT word, sum(k)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INTEGER) || substr(run, (h % length(run) + 2)::INTEGER) ELSE run END AS word, k FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INTEGER AS i FROM words)),
pairs AS (
  SELECT a.word AS word, a.n AS n, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
near AS (
  SELECT word, n, count(*) AS n_near, max(near_n) AS most, first(near ORDER BY near_n DESC, near) AS best FROM (SELECT DISTINCT * FROM pairs) GROUP BY word, n),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * w.n THEN best END AS form, CASE WHEN most >= 10 * w.n THEN most END AS form_n
  FROM words w LEFT JOIN near USING (word)),
steps AS (
  SELECT word, word AS root, form AS next FROM formed
  UNION ALL SELECT s.word, f.word, f.form FROM steps s JOIN formed f ON s.next = f.word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN (SELECT word, root FROM steps WHERE next IS NULL) USING (word)
"""
