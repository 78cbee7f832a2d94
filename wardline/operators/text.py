"""Notes as tokens, chunks, labelled spans and relations.

Tokens are runs of characters other than white space, with half-open character places; a tokenizer of one's own can
stand in for ``tokens`` as long as it gives the same columns. Spans are structs of start, end, label, confidence, id.
"""

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Which label wins where spans overlap, highest first: fixed values.
LABEL_PRIORITY = {"PLAN": 3, "TIME": 2, "C_ENT": 1}
#: Pairs of labels that may be related: fixed values.
ALLOWED = (("C_ENT", "TIME", "TIME_RELATION"), ("TABLE", "TIME", "TIME_RELATION"), ("C_ENT", "NEGATION", "NEGATION_RELATION"))
NEGATION_CUES = r"(?i)\b(no evidence of|no sign of|negative for|denies|without|not|no)\b"


def exploded(df: DataFrame, key: str, spans: str = "spans") -> DataFrame:
    """key and the fields of each span, with ord, its place in the list. Null lists and null entries give no row."""
    return df.select(key, F.posexplode(spans).alias("ord", "_s")).filter("_s is not null").select(key, "ord", "_s.*")


#: White space of tokens: fixed values.
_WORD = re.compile(r"[^ \t\n\r\f\v]+")


#: Bytes of text, and texts, that are taken from a batch at once.
RUN_BYTES, RUN_TEXTS = 1 << 20, 512


def runs(batches: Iterable[tuple[pa.Array, ...]]) -> Iterator[list[list]]:
    """Short runs of the rows of batches, as lists by column; the texts are the first column.

    A batch holds up to ten thousand texts, whose words as Python objects would take gigabytes; so no more than a run
    of them is there at a time.
    """
    for columns in batches:
        begin, held, sizes = 0, 0, [x or 0 for x in pc.binary_length(columns[0]).to_pylist()]
        for i, n in enumerate(sizes):
            if i > begin and (held + n > RUN_BYTES or i - begin == RUN_TEXTS):
                yield [x.slice(begin, i - begin).to_pylist() for x in columns]
                begin, held = i, 0
            held += n
        if sizes:
            yield [x.slice(begin).to_pylist() for x in columns]


def token_list(text: Column) -> Column:
    """Array of (start, end, token), the words of a text in order with their places; null for null."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("token", pa.string())]))

    @F.arrow_udf("array<struct<start:int,end:int,token:string>>")
    def words(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else [{"start": m.start(), "end": m.end(), "token": m[0]} for m in _WORD.finditer(t)] for t in texts.to_pylist()], kind)

    return words(text)


def tokens(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, i, start, end, token: words in order with their places, without moving any row. Texts without words give no row."""
    return df.select(key, F.posexplode(token_list(F.col(text))).alias("i", "_w")).select(key, "i", "_w.start", "_w.end", "_w.token")


def windows(n: Column, size: int = 512, overlap: float = 0.25) -> Column:
    """array of (chunk, first, last): windows of ``size`` over n tokens, last exclusive, until the end is reached; empty for none."""
    stride = max(1, int(size * (1 - overlap)))
    last = F.greatest(F.lit(0), F.ceil((n - size) / stride)).cast("int")
    one = lambda c: F.struct(c.alias("chunk"), (c * stride).alias("first"), F.least(c * stride + size, n.cast("int")).alias("last"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), one)).otherwise(F.array().cast("array<struct<chunk:int,first:int,last:int>>"))


def chunks(counts: DataFrame, n: str = "n", size: int = 512, overlap: float = 0.25) -> DataFrame:
    """One row for each window; the columns of counts but n, and chunk, first, last, n_chunks."""
    rest = [c for c in counts.columns if c != n]
    return counts.select(*rest, windows(F.col(n), size, overlap).alias("_w")).select(*rest, F.size("_w").alias("n_chunks"), F.explode("_w").alias("w")).select(*rest, "w.chunk", "w.first", "w.last", "n_chunks")


def trusted(chunked: DataFrame, low: float = 0.15, high: float = 0.85) -> DataFrame:
    """Adds keep_from and keep_to, the token places within a chunk that are trusted; open at the ends of the text."""
    n = F.col("last") - F.col("first")
    return chunked.withColumns({"keep_from": F.when(F.col("chunk") == 0, 0).otherwise(F.floor(n * F.lit(low)).cast("int")), "keep_to": F.when(F.col("chunk") == F.col("n_chunks") - 1, n).otherwise(F.floor(n * F.lit(high)).cast("int"))})


def centred(chunked: DataFrame, share: float = 0.8) -> DataFrame:
    """keep_from and keep_to of the central share, both inclusive in the sense of the trusted middle of relations."""
    n = F.col("last") - F.col("first")
    margin = F.floor(n * F.lit(round((1 - share) / 2, 6))).cast("int")
    return chunked.withColumns({"keep_from": F.when(F.col("chunk") == 0, 0).otherwise(margin), "keep_to": F.when(F.col("chunk") == F.col("n_chunks") - 1, n).otherwise(n - margin)})


def word_places(text: Column) -> Column:
    """Arrays start and end, the places of the words of a text in order, in a struct; both null for null."""

    @F.arrow_udf("struct<start:array<int>,end:array<int>>")
    def places(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return place_runs(batches)

    return places(text)


def place_runs(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """What word_places gives, run by run."""
    for (run,) in runs((x,) for x in batches):
        offsets, start, end = [], [], []
        for t in run:
            offsets.append(None if t is None else len(start))
            for m in _WORD.finditer(t or ""):
                start.append(m.start())
                end.append(m.end())
        at = pa.array([*offsets, len(start)], pa.int32())
        yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in (start, end)], ["start", "end"])


def chunk_spans(df: DataFrame, key: str, text: str = "text", spans: str = "spans", size: int = 512, overlap: float = 0.25) -> DataFrame:
    """Spans that meet a chunk of their text, with places counted from its begin and cut to it: key, chunk, char_from, char_to, ord, start, end, label.

    All is found within the row of a text, so nothing is moved or joined; rows without a key are left out.
    """
    part = F.transform(spans, lambda x: F.struct(x["start"].alias("s"), x["end"].alias("e"), x["label"].alias("label")))
    p = df.filter(F.col(key).isNotNull()).select(key, part.alias("_s"), word_places(F.col(text)).alias("_p"))
    begin, end = F.col("_p.start"), F.col("_p.end")
    bounds = F.transform(windows(F.size(begin), size, overlap), lambda w: F.struct(w["chunk"].alias("chunk"), F.get(begin, w["first"]).alias("char_from"), F.get(end, w["last"] - 1).alias("char_to")))
    c = p.select(key, "_s", F.explode(bounds).alias("_c")).select(key, "_c.*", F.posexplode("_s").alias("ord", "_s")).select(key, "chunk", "char_from", "char_to", "ord", "_s.*")
    met = c.filter("e > s and e > char_from and s < char_to")
    return met.select(key, "chunk", "char_from", "char_to", "ord", (F.greatest("s", "char_from") - F.col("char_from")).alias("start"), (F.least("e", "char_to") - F.col("char_from")).alias("end"), "label")


#: Characters of a stretch of text; tokens and spans meet within the stretches that they reach into.
STRETCH = 256


def bio_labels(toks: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """key, i, start, end, label: O, or B-/I- with the label of the highest priority that meets the token; B where the token before has another.

    Labels without a priority rank below the others, by name. Tokens and spans meet by stretches of the text, so a
    long text with many spans does not make all their pairs.
    """
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LABEL_PRIORITY.items() for x in kv]), F.col("label")), F.lit(0))
    reach = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / STRETCH), F.floor((F.col(b) - 1) / STRETCH)))
    s = spans.filter("end > start and start >= 0").select(F.col(key).alias("_k"), F.col("start").alias("s"), F.col("end").alias("e"), "label", rank.alias("rank")).withColumn("_b", reach("s", "e"))
    t = toks.select(key, "i", "start", "end").withColumn("_at", reach("start", "end"))
    m = t.join(s, (F.col(key) == F.col("_k")) & (F.col("_at") == F.col("_b")) & (F.col("e") > F.col("start")) & (F.col("s") < F.col("end")), "left")
    best = m.groupBy(key, "i", "start", "end").agg(F.max(F.when(F.col("label").isNotNull(), F.struct("rank", "label")))["label"].alias("l"))
    before = F.lag("l").over(Window.partitionBy(key).orderBy("i"))
    return best.select(key, "i", "start", "end", F.when(F.col("l").isNull(), "O").when(before.eqNullSafe(F.col("l")), F.concat(F.lit("I-"), "l")).otherwise(F.concat(F.lit("B-"), "l")).alias("label"))


def bio_spans(labels: DataFrame, key: str, least: float | None = None) -> DataFrame:
    """Spans from labelled tokens (key, i, start, end, label[, confidence]): a B begins one, an I of its label goes on with it.

    With ``least``, tokens of a lower confidence count as O. An I after anything else is left out. The confidence of
    a span is the highest of its tokens, 1 where there is none. Numbered e1.. by start and end.
    """
    conf = F.col("confidence") if "confidence" in labels.columns else F.lit(1.0)
    x = labels.select(key, "i", "start", "end", F.when(conf < least, "O").otherwise(F.col("label")).alias("label") if least is not None else F.col("label"), conf.alias("confidence"))
    w = Window.partitionBy(key).orderBy("i")
    kind = F.substring("label", 3, 100)
    part, of = F.substring("label", 1, 1), F.when(F.col("label") != "O", kind)
    goes_on = (part == "I") & F.lag("label").over(w).isNotNull() & F.lag(of).over(w).eqNullSafe(of)
    x = x.withColumn("_on", F.coalesce(goes_on, F.lit(False))).withColumn("_g", F.sum(F.when(F.col("_on"), 0).otherwise(1)).over(w)).withColumn("_of", of)
    g = x.groupBy(key, "_g").agg(F.min_by("label", "i").alias("_first"), F.first("_of", True).alias("label"), F.min("start").alias("start"), F.max("end").alias("end"), F.max("confidence").alias("confidence"))
    g = g.filter(F.col("_first").startswith("B-"))
    n = F.row_number().over(Window.partitionBy(key).orderBy("start", "end", "label"))
    return g.select(key, F.concat(F.lit("e"), n).alias("id"), "start", "end", "label", F.round("confidence", 3).alias("confidence"))


def token_labels(text: str, spans: list[tuple[int, int, str]]) -> tuple[list[tuple[int, int]], list[str]]:
    """Places of the words of a text and their labels, as bio_labels gives them."""
    places = [m.span() for m in _WORD.finditer(text)]
    begin, end = ([p[j] for p in places] for j in (0, 1))
    best: list[tuple[int, str] | None] = [None] * len(places)
    for a, b, label in spans:
        mine = (LABEL_PRIORITY.get(label, 0), label)
        for i in range(bisect_right(end, a), bisect_left(begin, b)):
            if best[i] is None or best[i] < mine:
                best[i] = mine
    return places, ["O" if x is None else ("I-" if i and best[i - 1] and best[i - 1][1] == x[1] else "B-") + x[1] for i, x in enumerate(best)]


def widened(labels: list[str]) -> list[str]:
    """BIO labels whose entities take in the free word before and after them; a word between two entities goes to the first."""
    kind = [None, *(x[2:] if x != "O" else None for x in labels), None]
    out = list(labels)
    for i, x in enumerate(labels):
        if x != "O":
            continue
        if kind[i]:
            out[i] = f"I-{kind[i]}"
        elif kind[i + 2]:
            out[i], out[i + 1] = f"B-{kind[i + 2]}", f"I-{kind[i + 2]}"
    return out


def islands(places: list[tuple[int, int]], labels: list[str], confidence: list[float] | None = None, least: float | None = None) -> list[dict]:
    """Spans of one text from its labelled words, as bio_spans gives them."""
    out: list[list] = []
    before = None
    for i, (a, b) in enumerate(places):
        c = 1.0 if confidence is None else confidence[i]
        label = labels[i] if least is None or c >= least else "O"
        kind = label[2:] if label != "O" else None
        if label.startswith("B-"):
            out.append([a, b, kind, c])
        elif kind is None or kind != before:
            kind = None  # what an I after anything else begins is left out
        else:
            out[-1][1], out[-1][3] = max(out[-1][1], b), max(out[-1][3], c)
        before = kind
    return [{"id": f"e{i}", "start": a, "end": b, "label": k, "confidence": round(c, 3)} for i, (a, b, k, c) in enumerate(sorted(out, key=lambda x: x[:3]), 1)]


def annotated(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[list[tuple[str | None, list[tuple[int, int, str]]]]]:
    """Short runs of texts with their sound spans, from batches of texts and their spans' starts, ends and labels."""
    for run in runs(batches):
        yield [(t, [s for s in zip(a or (), b or (), c or ()) if None not in s and s[1] > s[0] >= 0]) for t, a, b, c in zip(*run)]


def _parts(spans: Column) -> list[Column]:
    return [F.transform(spans, lambda x: x[c]) for c in ("start", "end", "label")]  # noqa: B023


def label_runs(batches: Iterator[tuple[pa.Array, ...]], widen: bool = False) -> Iterator[pa.Array]:
    """What labelled adds, run by run; columns of numbers and labels are filled, so no word is an object of its own."""
    for run in annotated(batches):
        offsets, number, start, end, label = [], [], [], [], []
        for t, spans in run:
            offsets.append(None if t is None else len(number))
            if t is not None:
                places, labels = token_labels(t, spans)
                number += range(len(places))
                start += [a for a, _ in places]
                end += [b for _, b in places]
                label += widened(labels) if widen else labels
        words = [pa.array(x, pa.int32()) for x in (number, start, end)] + [pa.array(label, pa.string())]
        yield pa.ListArray.from_arrays(pa.array([*offsets, len(number)], pa.int32()), pa.StructArray.from_arrays(words, ["i", "start", "end", "label"]))


def labelled(df: DataFrame, text: str = "text", spans: str = "spans", widen: bool = False) -> DataFrame:
    """df with labels, an array of (i, start, end, label): the BIO labels of the words of each text, without moving any row.

    With ``widen``, entities take in one free word on either side.
    """

    @F.arrow_udf("array<struct<i:int,start:int,end:int,label:string>>")
    def of(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return label_runs(batches, widen)

    # else a filter on the size of the list that goes with its explosion has all labels made twice
    return df.withColumn("labels", of.asNondeterministic()(F.col(text), *_parts(F.col(spans))))


def entity_runs(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """What entities gives, run by run."""
    kind = pa.list_(pa.struct([("id", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("confidence", pa.float64())]))
    for run in annotated(batches):
        yield pa.array([None if t is None else islands(*token_labels(t, spans)) for t, spans in run], kind)


def entities(text: Column, spans: Column) -> Column:
    """Array of (id, start, end, label, confidence): joined_spans of the labels of a text, which are not kept; null for null."""

    @F.arrow_udf("array<struct<id:string,start:int,end:int,label:string,confidence:double>>")
    def of(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return entity_runs(batches)

    return of(text, *_parts(spans))


def joined_spans(labels: Column, least: float | None = None) -> Column:
    """Array of (id, start, end, label, confidence) from an array of labelled words (i, start, end, label[, confidence])."""
    kind = pa.list_(pa.struct([("id", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("confidence", pa.float64())]))

    @F.arrow_udf("array<struct<id:string,start:int,end:int,label:string,confidence:double>>")
    def of(lists: pa.Array) -> pa.Array:
        out = []
        for x in lists.to_pylist():
            conf = [w["confidence"] for w in x] if x and "confidence" in x[0] else None
            out.append(None if x is None else islands([(w["start"], w["end"]) for w in x], [w["label"] for w in x], conf, least))
        return pa.array(out, kind)

    return of(labels)


def without_overlaps(spans: Column, min_length: int = 1) -> Column:
    """Array of spans, each kept unless it meets one of higher confidence that is kept; null confidence counts as 1.

    Ties go to the earlier start, then end, then id.
    """
    conf = lambda s: F.coalesce(s["confidence"], F.lit(1.0))

    def order(x: Column, y: Column) -> Column:
        out = F.lit(0)
        for a, b in reversed([(conf(y), conf(x)), (x["start"], y["start"]), (x["end"], y["end"]), (x["id"], y["id"])]):
            out = F.when(a < b, -1).when(a > b, 1).otherwise(out)
        return out

    long = F.array_sort(F.filter(spans, lambda s: s.isNotNull() & (s["end"] - s["start"] >= min_length)), order)
    free = lambda acc, s: ~F.exists(acc, lambda k: (k["start"] < s["end"]) & (k["end"] > s["start"]))
    return F.aggregate(long, F.slice(long, 1, 0), lambda acc, s: F.when(free(acc, s), F.concat(acc, F.array(s))).otherwise(acc))


def marks(text: Column, literal: str = "[TABLE]") -> Column:
    """Places where a literal stands in a text, as an array of start positions from 0, repeats not overlapping."""
    pieces = F.split(text, r"\Q" + literal + r"\E", -1)
    lens = F.transform(pieces, lambda p: F.length(p))
    starts = F.aggregate(F.slice(lens, 1, F.greatest(F.size(lens) - 1, F.lit(0))), F.array().cast("array<int>"), lambda acc, n: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)) + len(literal), F.lit(0)) + n)))
    return starts


def tagged(text: Column, spans: Column) -> Column:
    """Text with every span in a tag of its label and id, set from the back so that places hold."""
    back = F.array_sort(F.filter(spans, lambda s: s.isNotNull()), lambda x, y: F.when(x["start"] > y["start"], -1).when(x["start"] < y["start"], 1).when(x["end"] < y["end"], -1).when(x["end"] > y["end"], 1).otherwise(0))

    def put(acc: Column, s: Column) -> Column:
        a, n = s["start"], s["end"] - s["start"]
        name = F.lower(s["label"])
        return F.concat(acc.substr(F.lit(1), a), F.lit("<"), name, F.lit(' id="'), s["id"], F.lit('">'), acc.substr(a + 1, n), F.lit("</"), name, F.lit(">"), acc.substr(s["end"] + 1, F.length(acc)))

    return F.aggregate(back, text, put)


def pair_marked(text: Column, head_start: Column, head_end: Column, child_start: Column, child_end: Column) -> Column:
    """Text with HEAD and CHILD tags around two spans that don't overlap."""
    first = head_start <= child_start
    a, b = F.when(first, head_start).otherwise(child_start), F.when(first, head_end).otherwise(child_end)
    c, d = F.when(first, child_start).otherwise(head_start), F.when(first, child_end).otherwise(head_end)
    x, y = F.when(first, "HEAD").otherwise("CHILD"), F.when(first, "CHILD").otherwise("HEAD")
    cut = lambda p, q: text.substr(p + 1, q - p)
    wrap = lambda t, s: F.concat(F.lit("<"), t, F.lit(">"), s, F.lit("</"), t, F.lit(">"))
    return F.concat(cut(F.lit(0), a), wrap(x, cut(a, b)), cut(b, c), wrap(y, cut(c, d)), cut(d, F.length(text)))


def allowed_pairs(spans: DataFrame, keys: list[str], allowed=ALLOWED, at: str = "start", farthest: int | None = None) -> DataFrame:
    """Ordered pairs of spans of one text whose labels may be related: keys, head, child, label[, distance].

    Spans meet by key and label, so pairs of other labels are never made; with ``farthest``, only spans in neighbouring
    stretches of that length meet, so a long text does not make all its pairs.
    """
    kinds = spans.sparkSession.createDataFrame(list(allowed), "_a string, _b string, rel string")
    h = spans.select(*keys, F.col("id").alias("head"), F.col("label").alias("_a"), F.col(at).alias("_x"))
    c = spans.select(*keys, F.col("id").alias("child"), F.col("label").alias("_b"), F.col(at).alias("_y"))
    h = h.join(F.broadcast(kinds), "_a")
    on = [*keys, "_b"]
    if farthest:
        h = h.withColumn("_near", F.floor(F.col("_x") / farthest))
        c = c.withColumn("_near", F.explode(F.array(*[F.floor(F.col("_y") / farthest) + d for d in (-1, 0, 1)])))
        on.append("_near")
    p = h.join(c, on).filter("head <> child").withColumn("distance", F.abs(F.col("_x") - F.col("_y")))
    if farthest:
        p = p.filter(F.col("distance") <= farthest)
    return p.select(*keys, "head", "child", F.col("rel").alias("label"), "distance")


def best_relations(relations: DataFrame, keys: list[str]) -> DataFrame:
    """One relation for each head and child: that of the highest confidence; ties go to the earlier in ``ord``, null counts as 0."""
    w = Window.partitionBy(*keys, "head", "child").orderBy(F.coalesce("confidence", F.lit(0.0)).desc(), "ord")
    return relations.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def training_pairs(pairs: DataFrame, relations: DataFrame, keys: list[str], far_positive: int = 100, far_control: int = 30, share: float = 0.05, seed: int = 3) -> DataFrame:
    """Pairs for training: annotated ones up to ``far_positive`` apart, others up to ``far_control``, and a share of the farther others.

    The share is taken by a seeded hash of the pair. label is NO_RELATION for the others.
    """
    on = [*keys, "head", "child", "label"]
    said = relations.select(*on).distinct().withColumn("_yes", F.lit(True))
    x = pairs.join(said, on, "left")
    draw = F.pmod(F.xxhash64(F.lit(seed), *on), F.lit(1_000_000)) < int(share * 1_000_000)
    yes = F.col("_yes").isNotNull()
    keep = F.when(yes, F.col("distance") <= far_positive).otherwise((F.col("distance") <= far_control) | ((F.col("distance") <= far_positive) & draw))
    return x.filter(keep).select(*keys, "head", "child", F.when(yes, F.col("label")).otherwise("NO_RELATION").alias("label"), "distance")


def divided(df: DataFrame, key: str, n_dev: int, seed: int = 5) -> DataFrame:
    """Adds part: dev for the first n_dev rows in the order of a seeded hash, train for the rest.

    The edge is found from the n_dev lowest hashes alone, so no task orders all rows.
    """
    h = F.xxhash64(F.lit(seed), key)
    if n_dev < 1:
        return df.withColumn("part", F.lit("train"))
    dev = df.select(key, h.alias("_h")).orderBy("_h", key).limit(n_dev).select(key).withColumn("part", F.lit("dev"))
    return df.join(dev, key, "left").withColumn("part", F.coalesce("part", F.lit("train")))


def class_weights(labels: DataFrame, label: str = "label") -> DataFrame:
    """label, n, weight: all rows over the rows of the label."""
    g = labels.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("weight", F.sum("n").over(Window.partitionBy()) / F.col("n"))


def metrics(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """label, tp, fp, fn, precision, recall, f1, accuracy (of all rows). Ratios without a denominator are 0."""
    g = df.groupBy(truth, guess).agg(F.count(F.lit(1)).alias("n"))
    both = g.select(F.col("n"), F.explode(F.array(F.struct(F.col(truth).alias("label"), F.lit(True).alias("is_truth")), F.struct(F.col(guess).alias("label"), F.lit(False).alias("is_truth")))).alias("x"), (F.col(truth) == F.col(guess)).alias("hit"))
    s = both.groupBy("x.label").agg(
        F.sum(F.when(F.col("hit") & F.col("x.is_truth"), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(~F.col("hit") & ~F.col("x.is_truth"), F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when(~F.col("hit") & F.col("x.is_truth"), F.col("n")).otherwise(0)).alias("fn"),
    )
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    all_ = F.sum(F.col("tp") + F.col("fn")).over(Window.partitionBy())
    return s.select("label", "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"), ratio(F.sum("tp").over(Window.partitionBy()), all_).alias("accuracy"))


def with_token_places(df: DataFrame, key: str, text: str = "text", spans: str = "spans") -> DataFrame:
    """The spans of each text (see exploded), with token, the number of words that end at or before the begin of the span."""

    @F.arrow_udf("array<int>")
    def places(texts: pa.Array, starts: pa.Array) -> pa.Array:
        out = []
        for t, s in zip(texts.to_pylist(), starts.to_pylist()):
            ends = [m.end() for m in _WORD.finditer(t or "")]
            out.append(None if t is None or s is None else [None if x is None else bisect_right(ends, x) for x in s])
        return pa.array(out, pa.list_(pa.int32()))

    at = places(F.col(text), F.transform(spans, lambda x: x["start"]))
    both = df.select(key, spans, at.alias("_at")).select(key, F.posexplode(F.arrays_zip(F.col(spans).alias("s"), F.col("_at").alias("token"))).alias("ord", "_z"))
    return both.select(key, "ord", "_z.s", "_z.token").filter("s is not null").select(key, "ord", "s.*", "token")


def extracted(df: DataFrame, model: Callable[[], Callable[[list[str]], list[list[dict]]]], text: str = "text", least: float = 0.0) -> DataFrame:
    """df with found, an array of (id, start, end, label, confidence): what a model of one's own finds in each text.

    ``model`` is called once in each Python worker and gives a function from texts to lists of spans; texts come to it
    by Arrow batches and no row is moved. Spans below the confidence ``least`` are left out; null texts have none.
    """
    kind = pa.list_(pa.struct([("id", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("confidence", pa.float64())]))
    loaded: list[Callable[[list[str]], list[list[dict]]]] = []

    @F.arrow_udf("array<struct<id:string,start:int,end:int,label:string,confidence:double>>")
    def found(texts: pa.Array) -> pa.Array:
        if not loaded:
            loaded.append(model())
        ts = texts.to_pylist()
        of = iter(loaded[0]([t for t in ts if t is not None]))
        rows = [None if t is None else [{"id": s.get("id") or f"e{i}", "start": s["start"], "end": s["end"], "label": s["label"], "confidence": s.get("confidence", 1.0)} for i, s in enumerate(next(of), 1) if s.get("confidence", 1.0) >= least] for t in ts]
        return pa.array(rows, kind)

    return df.withColumn("found", found(F.col(text)))


def related(pairs: DataFrame, model: Callable[[], Callable[[list[str]], list[tuple[str, float]]]], marked: str, least: float = 0.6) -> DataFrame:
    """pairs with relation and confidence, those that a model of one's own sets above ``least``; NO_RELATION gives no row.

    ``marked`` holds the text of a pair with its head and child in tags; the model gives a label and a confidence for each.
    """
    loaded: list[Callable[[list[str]], list[tuple[str, float]]]] = []

    @F.arrow_udf("struct<relation:string,confidence:double>")
    def found(texts: pa.Array) -> pa.Array:
        if not loaded:
            loaded.append(model())
        ts = texts.to_pylist()
        of = iter(loaded[0]([t for t in ts if t is not None]))
        return pa.array([None if t is None else dict(zip(("relation", "confidence"), next(of))) for t in ts], pa.struct([("relation", pa.string()), ("confidence", pa.float64())]))

    r = pairs.withColumn("_r", found(F.col(marked))).select(*[c for c in pairs.columns if c not in ("relation", "confidence")], "_r.relation", "_r.confidence")
    return r.filter((F.col("relation") != "NO_RELATION") & (F.col("confidence") > least))


def settled(spans: DataFrame, relations: DataFrame, keys: list[str], concept: str = "C_ENT") -> DataFrame:
    """For each concept the one time and the negation that hold: keys, id, time_id, negation_id, negated, n_times, n_negations.

    Of several relations of a kind the one of the highest confidence holds, then the one that stands nearest, then the
    earlier one (null confidence counts as 0). A concept is negated if its best negation is at least as sure as its best
    time is; a sure time speaks for something that took place. Relations to missing spans count for nothing.
    """
    place = spans.select(*keys, "id", "start").groupBy(*keys, "id").agg(F.min("start").alias("start"))
    c = spans.filter(F.col("label") == concept).select(*keys, "id").distinct()
    side = lambda name: place.select(*keys, F.col("id").alias(name), F.col("start").alias(f"_{name}"))
    r = relations.join(side("head"), [*keys, "head"]).join(side("child"), [*keys, "child"])
    rank = F.struct((-F.coalesce("confidence", F.lit(0.0))).alias("c"), F.abs(F.col("_head") - F.col("_child")).alias("far"), F.col("_child").alias("at"), F.col("child").alias("child"))
    kind = {"time": F.col("label") == "TIME_RELATION", "negation": F.col("label") == "NEGATION_RELATION"}
    best = r.groupBy(*keys, F.col("head").alias("id")).agg(*[x for n, k in kind.items() for x in (F.min(F.when(k, rank)).alias(n), F.count_distinct(F.when(k, F.col("child"))).alias(f"n_{n}s"))])
    d = c.join(best, [*keys, "id"], "left")
    sure = lambda n: -F.col(f"{n}.c")
    negated = F.col("negation").isNotNull() & (F.col("time").isNull() | (sure("negation") >= sure("time")))
    zero = F.lit(0).cast("bigint")
    return d.select(*keys, "id", F.col("time.child").alias("time_id"), F.col("negation.child").alias("negation_id"), F.coalesce(negated, F.lit(False)).alias("negated"), F.coalesce("n_times", zero).alias("n_times"), F.coalesce("n_negations", zero).alias("n_negations"))


# notes ---------------------------------------------------------------------------------------------------------------


def pipe_cells(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Cells of tables of lines framed by bars: key, line (from 0), header, cell, column (from 0).

    The nearest line above that is framed by bars and follows on a line that isn't is the header; rules of dashes and
    empty cells give no row; cells beyond the header have a null one.
    """
    lines = df.select(key, F.posexplode(F.split(text, r"\r\n|\n|\r")).alias("line", "raw")).withColumn("t", F.trim("raw"))
    bar = F.col("t").startswith("|") & F.col("t").endswith("|") & (F.length("t") > 1)
    w = Window.partitionBy(key).orderBy("line")
    x = lines.select(key, "line", "t", bar.alias("bar")).withColumn("head", F.col("bar") & ~F.coalesce(F.lag("bar").over(w), F.lit(False)))
    cells = F.transform(F.split(F.expr("substring(t, 2, length(t) - 2)"), r"\|", -1), lambda c: F.trim(c))
    x = x.withColumn("cells", F.when(F.col("bar"), cells)).withColumn("names", F.last(F.when(F.col("head"), F.col("cells")), True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = x.filter("bar and not head and not t rlike '^[-|: ]+$'").select(key, "line", "names", F.posexplode("cells").alias("column", "cell")).filter("cell <> ''")
    return rows.select(key, "line", F.get("names", F.col("column")).alias("header"), "cell", "column")


def parsed_value(c: Column) -> tuple[Column, Column]:
    """Number and sign of censoring (<, > or null) of a cell; null where there is no number at its begin."""
    return F.regexp_extract(c, r"^[<>]?\s*(-?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double"), F.nullif(F.regexp_extract(c, r"^([<>])", 1), F.lit(""))


def negation_cues(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, cue, n: how often each cue of negation stands in a text, in lower case."""
    cue = F.explode(F.regexp_extract_all(F.col(text), F.lit(NEGATION_CUES), 1)).alias("cue")
    return df.select(key, cue).groupBy(key, F.lower("cue").alias("cue")).agg(F.count(F.lit(1)).alias("n"))


def stated_days(df: DataFrame, key: str, admitted: str, text: str = "text") -> DataFrame:
    """key, written, day: offsets from admission of the days that a text states.

    Read are ``day N`` and ``HD N`` or ``HD#N`` (day 1 of the stay is offset 0), ISO dates, and M/D with or without a
    year; a date without a year is the one nearest to admission. Dates that don't exist give no row.
    """
    found = F.explode(F.regexp_extract_all(F.col(text), F.lit(r"(?i)\b((?:hospital day|day|HD) ?#?[0-9]{1,3}|[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}(?:/[0-9]{2,4})?)\b"), 1)).alias("written")
    x = df.select(key, F.to_date(admitted).alias("_a"), found)
    n = F.regexp_extract("written", r"(?i)^(?:hospital day|day|HD) ?#?([0-9]+)$", 1).try_cast("int")
    iso = F.try_to_date("written", "yyyy-MM-dd")
    m, d, y = (F.regexp_extract("written", r"^([0-9]{1,2})/([0-9]{1,2})(?:/([0-9]{2,4}))?$", i).try_cast("int") for i in (1, 2, 3))
    year = F.when(y < 100, y + 2000).otherwise(y)
    make = lambda yy: F.try_to_date(F.concat_ws("-", F.lpad(yy.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), "yyyy-MM-dd")
    near = F.array_min(F.transform(F.filter(F.array(*[make(F.year("_a") + k) for k in (-1, 0, 1)]), lambda z: z.isNotNull()), lambda z: F.struct(F.abs(F.datediff(z, F.col("_a"))).alias("far"), z.alias("z"))))["z"]
    when = F.coalesce(iso, F.when(y.isNotNull(), make(year)).when(m.isNotNull(), near))
    day = F.when(n.isNotNull(), n - 1).otherwise(F.datediff(when, F.col("_a")))
    return x.select(key, "written", day.cast("int").alias("day")).filter("day is not null")
