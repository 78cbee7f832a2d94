"""Free entries mapped to a canonical list by token-level repair and soft TF-IDF.

Every distinct word of the entries is joined to the words of the reference list by edit distance (insertions,
deletions, substitutions and swaps of neighbours); the entry run together is a word of its own, joined to the aliases
run together, so that a misplaced space does no harm. The repaired words are then weighed by soft TF-IDF against whole
aliases, in any order of words. Words that explain nothing count against a match, except decoration: marks of the
charting staff, and unknown words that occur beside many different words of the list.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.catalog import bounded_rows
from wardline.operators.skew import looked_up, salted_join
from wardline.session import cut_lineage

UNMATCHED = "unmatched"
MAX_ALIASES = 100_000
#: Words that charting adds around a name.
DECORATION = ("pt", "with", "per", "rn", "repeat", "today", "am", "draw")
WORD = r"[\p{L}\p{N}+]+"


def words_of(text: Column) -> Column:
    """Lower-case words of an entry, without decoration, in order."""
    found = F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), 1)
    return F.filter(found, lambda w: ~w.isin(*DECORATION) & ~w.rlike("^x[0-9]+$"))


def osa(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours; most + 1 where it exceeds most. Only cells within ``most`` of the diagonal are worked out."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = most + 1
    before: dict[int, int] = {}
    row = {j: j for j in range(min(len(b), most) + 1)}
    for i, x in enumerate(a, 1):
        low, high = max(0, i - most), min(len(b), i + most)
        new = {}
        for j in range(low, high + 1):
            d = min(row.get(j, far) + 1, new.get(j - 1, far) + 1)
            if j:
                d = min(d, row.get(j - 1, far) + (x != b[j - 1]))
                if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == b[j - 1]:
                    d = min(d, before.get(j - 2, far) + 1)
            new[j] = d
        if min(new.values()) > most:
            return far
        before, row = row, new
    return min(row.get(len(b), far), far)


def room(n: int) -> int:
    """Edits allowed in a word of n letters."""
    return 0 if n < 3 else 1 if n < 6 else 2


def shorter(w: str, k: int) -> set[str]:
    """w and what is left of it after up to k deletions."""
    out = last = {w}
    for _ in range(k):
        last = {x[:i] + x[i + 1 :] for x in last for i in range(len(x))}
        out = out | last
    return out


#: Letters of a word whose deletions are listed; longer words are held against the list's words of like length one by one.
LISTED = 40


@dataclass
class Index:
    """Words within two edits share what is left after two deletions each."""

    words: list[str]
    by: dict[str, list[int]] = field(default_factory=dict)
    long: dict[int, list[int]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for i, w in enumerate(self.words):
            self.long.setdefault(len(w), []).append(i)
            if len(w) <= LISTED + 2:
                for x in shorter(w, room(len(w))):
                    self.by.setdefault(x, []).append(i)

    def near(self, w: str) -> list[tuple[str, int]]:
        """Words of the list at the least distance that the length allows, with that distance."""
        best, out = room(len(w)), []
        if len(w) <= LISTED:
            seen = {i for x in shorter(w, best) for i in self.by.get(x, ())}
        else:
            seen = {i for n in range(len(w) - best, len(w) + best + 1) for i in self.long.get(n, ())}
        for i in sorted(seen):
            v = self.words[i]
            d = osa(w, v, min(best, room(len(v))))
            if d <= min(best, room(len(v))):
                if d < best:
                    best, out = d, []
                out.append((v, d))
        return out


@dataclass
class Aliases:
    """The active reference list: alias words, their weights, and the canonical of each alias."""

    words: list[tuple[str, ...]]
    canonical: list[str]
    priority: list[int]
    idf: dict[str, float] = field(default_factory=dict)
    having: dict[str, list[int]] = field(default_factory=dict)
    joined: dict[str, list[int]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for i, ws in enumerate(self.words):
            for w in set(ws):
                self.having.setdefault(w, []).append(i)
            self.joined.setdefault("".join(ws), []).append(i)
        self.idf = {w: math.log(1 + len(self.words) / len(a)) for w, a in self.having.items()}

    def rank(self, entry: list[tuple[str, list[tuple[str, int]]]], whole: list[tuple[str, int]], least: float) -> tuple[str, float]:
        """The canonical with the highest score, and the score; ties go to the lowest priority, then the name."""
        rare = math.log(1 + len(self.words))
        scores: dict[int, dict[str, float]] = {}
        norm = 0.0
        for w, near in entry:
            weight = max((self.idf[v] for v, _ in near), default=rare)
            norm += weight**2
            for v, d in near:
                like = 1 - d / max(len(w), len(v))
                for i in self.having[v]:
                    own = scores.setdefault(i, {})
                    own[v] = max(own.get(v, 0), weight * self.idf[v] * like)
        best: tuple = (0.0, 0, "")
        for i, own in scores.items():
            size = sum(self.idf[v] ** 2 for v in set(self.words[i]))
            best = max(best, (round(sum(own.values()) / math.sqrt(norm * size), 9), -self.priority[i], Reversed(self.canonical[i])))
        for v, d in whole:
            for i in self.joined[v]:
                best = max(best, (round(1 - d / len(v), 9), -self.priority[i], Reversed(self.canonical[i])))
        return (str(best[2]), best[0]) if best[0] >= least else (UNMATCHED, best[0])


class Reversed(str):
    """A name that is greater the earlier it stands in the alphabet."""

    def __lt__(self, other: str) -> bool:
        return str(self) > str(other)

    def __gt__(self, other: str) -> bool:
        return str(self) < str(other)


def read_aliases(alias_to_canonical: DataFrame) -> Aliases:
    """Active rows; a null status is active, a null priority 100; of one alias the lowest priority holds."""
    active = alias_to_canonical.filter(F.coalesce("status", F.lit("active")) == "active").filter("alias is not null and canonical is not null")
    rows = bounded_rows(active.select(words_of_alias(F.col("alias")).alias("w"), "canonical", F.coalesce("priority", F.lit(100)).alias("p")), MAX_ALIASES, "the list of aliases")
    held: dict[tuple[str, ...], tuple[int, str]] = {}
    for r in rows:
        k = tuple(r.w)
        if k and (k not in held or (r.p, r.canonical) < held[k]):
            held[k] = (r.p, r.canonical)
    keys = sorted(held)
    return Aliases(keys, [held[k][1] for k in keys], [held[k][0] for k in keys])


def words_of_alias(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), 1)


NEAR = "array<struct<v:string,d:int>>"


def repaired(words: DataFrame, vocabulary: Index, joined: Index) -> DataFrame:
    """word, whole -> near: the words of the list (of the aliases run together where whole) within the distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("v", pa.string()), ("d", pa.int32())]))
        for b in batches:
            ws, whole = b.column("word").to_pylist(), b.column("whole").to_pylist()
            near = [[{"v": v, "d": d} for v, d in (joined if o else vocabulary).near(w)] for w, o in zip(ws, whole)]
            yield pa.record_batch([b.column("word"), b.column("whole"), pa.array(near, kind)], names=["word", "whole", "near"])

    return words.select("word", "whole").mapInArrow(run, f"word string, whole boolean, near {NEAR}")


def map_entries(entries: DataFrame, alias_to_canonical: DataFrame, entry: str = "entry", least: float = 0.76, partners: float = 0.1) -> DataFrame:
    """Distinct non-null entries with their canonical, or ``unmatched``, and the score: entry, n, canonical, score.

    n counts the rows of an entry. An empty entry, or one of decoration only, is unmatched. A word unknown to the list
    that stands beside a share of ``partners`` or more of the list's words (over all distinct entries) is decoration too.
    """
    aliases = read_aliases(alias_to_canonical)
    vocabulary, joined = Index(sorted(aliases.idf)), Index(sorted(w for w in aliases.joined if len(w) >= 5))
    texts = cut_lineage(entries.filter(F.col(entry).isNotNull()).groupBy(F.col(entry).alias("entry")).agg(F.count(F.lit(1)).alias("n")))
    split = texts.select("entry", words_of(F.col("entry")).alias("ws"))
    run_together = F.array_join("ws", "")
    words = split.select("entry", F.explode(F.concat(F.transform("ws", lambda w: F.struct(w.alias("word"), F.lit(False).alias("whole"))), F.array(F.struct(run_together.alias("word"), F.lit(True).alias("whole"))))).alias("x")).select("entry", "x.word", "x.whole")
    near = cut_lineage(repaired(words.select("word", "whole").distinct(), vocabulary, joined))
    found = words.join(near, ["word", "whole"])
    grouped = cut_lineage(found.groupBy("entry").agg(F.collect_list(F.struct("word", "whole", "near")).alias("ws"), F.min(F.when(~F.col("whole") & (F.size("near") > 0), F.col("near")[0]["v"])).alias("one")))
    unknown = grouped.select("entry", "one", F.explode(F.filter("ws", lambda x: ~x["whole"] & (F.size(x["near"]) == 0))).alias("x")).select("entry", "one", "x.word")
    noise = unknown.groupBy("word").agg(F.count_distinct("one").alias("k")).filter(F.col("k") >= max(2.0, partners * len(aliases.idf))).select("word")
    marks = looked_up(unknown.select("entry", "word"), cut_lineage(noise), ["word"], "left_semi", "entry").groupBy("entry").agg(F.collect_set("word").alias("marks"))

    @F.arrow_udf("struct<canonical:string,score:double>")
    def rank(ws: pa.Array, marks: pa.Array) -> pa.Array:
        out = []
        for e, noise in zip(ws.to_pylist(), marks.to_pylist()):
            plain = [(x["word"], [(y["v"], y["d"]) for y in x["near"]]) for x in e if not x["whole"] and not (noise and x["word"] in noise)]
            whole = [(y["v"], y["d"]) for x in e if x["whole"] for y in x["near"]]
            c, s = aliases.rank(plain, whole, least)
            out.append({"canonical": c, "score": s})
        return pa.array(out, pa.struct([("canonical", pa.string()), ("score", pa.float64())]))

    ranked = grouped.join(marks, "entry", "left").select("entry", rank("ws", "marks").alias("r")).select("entry", "r.*")
    return texts.join(ranked, "entry").select("entry", "n", "canonical", "score")


def map_events(event_df: DataFrame, alias_to_canonical: DataFrame, least: float = 0.76) -> DataFrame:
    """Rows of event_df without a term whose source_entity is not null: event_id, source_entity, canonical, score."""
    open_ = event_df.filter(F.col("normalized_term").isNull() & F.col("source_entity").isNotNull()).select("event_id", "source_entity")
    mapped = map_entries(open_, alias_to_canonical, "source_entity", least)
    return salted_join(open_, mapped.withColumnRenamed("entry", "source_entity"), "source_entity", "n", "event_id")
