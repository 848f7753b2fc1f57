"""Secret scans with multipart credential linking.

Base patterns find secrets that stand for themselves. Weak parts (access
identifiers, bare secrets, endpoints) are reported only when complementary
parts lie near each other in a paragraph, found by an interval join within these scopes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from reportloom.functions.helpers import let
from reportloom.llm.common import private
from reportloom.session import materialize

# Kinds in their order, pattern, group that counts, least length.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
# Weak parts: an identifier, a secret or an endpoint alone may be harmless.
WEAK = (
    ("id", r"(?i)\b(?:(?:client|access|account|user|key)[_-]?(?:id|name)|login|user)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9@._-]{3,}"),
    ("key", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])"),
    ("host", r"(?i)(?:\b[a-z][a-z0-9+]{1,15}://[^\s\"'<>]+|\b(?:host|endpoint|server)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9.:_-]{3,})"),
)
# A cheap condition that every match of the pattern fulfils; spares most texts the pattern.
HINTS = {
    "assign": lambda t: t.rlike(r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"),
    "access": lambda t: t.contains("AKIA"),
    "hex": lambda t: t.rlike(r"[0-9a-f]{16}"),
    "id": lambda t: t.rlike(WEAK[0][1]),
    "key": lambda t: t.rlike(r"[A-Za-z0-9+/_-]{20}"),
    "host": lambda t: t.rlike(WEAK[2][1]),
}
# Blank lines end a paragraph, the scope in which parts are linked.
BREAK = ("break", r"\n[\x20\t\r]*\n")
HINTS[BREAK[0]] = lambda t: t.rlike(BREAK[1])
KINDS = [kind for kind, *_ in BASE] + [kind for kind, _ in WEAK] + [BREAK[0]]
REACH = 256  # code points; parts of a paragraph this near to each other belong together
SPAN = "struct<start:int,`order`:int,kind:string,stop:int>"


def running(values: Column, merge: Callable[[Column, Column], Column], block: int = 128) -> Column:
    """Inclusive running ``merge`` (sum or maximum) of an array of whole numbers.

    Arrays grow by copying, so blocks are run through on their own and then raised by what stands
    before them: the work for m values is about 128 m and not m squared.
    """
    none = F.array().cast("array<int>")

    def through(items: Column, value: Callable[[Column], Column]) -> Column:
        last = lambda acc: F.get(acc, F.size(acc) - 1)
        return F.aggregate(items, none, lambda acc, x: F.concat(acc, F.array(
            F.when(F.size(acc) > 0, merge(last(acc), value(x))).otherwise(value(x)).cast("int")
        )))

    def raised(blocks: Column) -> Column:
        ends = through(blocks, lambda b: F.get(b, F.size(b) - 1))
        before = F.concat(F.array(F.lit(None).cast("int")), ends)
        return F.flatten(F.zip_with(blocks, F.slice(before, F.lit(1), F.size(blocks)), lambda b, past: F.transform(
            b, lambda x: F.when(past.isNull(), x).otherwise(merge(past, x)).cast("int")
        )))

    def cut(items: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / block).cast("int"))
        return F.when(F.size(items) == 0, none).otherwise(
            let(F.transform(starts, lambda i: through(F.slice(items, i * block + 1, F.lit(block)), lambda x: x)), raised)
        )

    return let(values, cut)


def _sum(a: Column, b: Column) -> Column:
    return a + b


def _spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans (start, order, kind, stop) of the matches, in code points, the end exclusive.

    The text between matches comes from splitting by the same pattern, so running sums of
    lengths give the places. ``least`` bounds the length of ``group``.
    """
    if kind == "hex":  # a maximal run: shorter ones need not be listed first
        pattern = f"[0-9a-f]{{{least},}}"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    between = F.split(text, pattern, -1)
    sizes = F.zip_with(
        F.slice(between, F.lit(1), F.size(found)), F.arrays_zip(found.alias("all"), counted.alias("part")),
        lambda gap, m: F.struct((F.length(gap) + F.length(m["all"])).alias("step"), F.length(m["all"]).alias("size"), F.length(m["part"]).alias("part")),
    )
    order = F.lit(KINDS.index(kind)).cast("int")

    def placed(sizes: Column) -> Column:
        both = F.zip_with(running(F.transform(sizes, lambda m: m["step"]), _sum), sizes, lambda stop, m: F.struct(
            (stop - m["size"]).cast("int").alias("start"), stop.cast("int").alias("stop"), m["part"].alias("part")
        ))
        return F.transform(F.filter(both, lambda s: s["part"] >= least), lambda s: F.struct(
            s["start"].alias("start"), order.alias("order"), F.lit(kind).alias("kind"), s["stop"].alias("stop")
        )).cast(f"array<{SPAN}>")

    return F.when(HINTS[kind](text), let(sizes, placed)).otherwise(F.array().cast(f"array<{SPAN}>"))


def with_parts(df: DataFrame, text: Column) -> DataFrame:
    """Adds the spans of every base kind, ``base`` with all of them in order, ``weak`` parts, and ``breaks`` between paragraphs."""
    df = df.withColumns({f"s_{kind}": _spans(text, kind, pattern, group, least) for kind, pattern, group, least in BASE})
    df = df.withColumns({f"w_{kind}": _spans(text, kind, pattern, 0, 1) for kind, pattern in WEAK})
    df = df.withColumns({
        "base": F.array_sort(F.concat(*(f"s_{kind}" for kind, *_ in BASE))),
        "weak": F.concat(*(f"w_{kind}" for kind, _ in WEAK)),
    }).drop(*(f"w_{kind}" for kind, _ in WEAK))
    breaks = F.when(linkable(), _spans(text, *BREAK, 0, 1)).otherwise(F.array().cast(f"array<{SPAN}>"))
    return df.withColumn("breaks", breaks)


def linkable() -> Column:
    """At least two parts, one of them weak: otherwise nothing can be linked."""
    return (F.size("weak") > 0) & (F.size("weak") + F.size("base") > 1)


def scoped_parts(parts: DataFrame) -> DataFrame:
    """One row per part that can be linked: its place, its role, and ``scope``, the number of its paragraph.

    A weak part that overlaps a base match is no candidate. Both come from running figures over the parts of a
    document in order, so the work grows with their number only.
    """
    kind, start, stop = F.col("part.kind"), F.col("part.start"), F.col("part.stop")
    role = F.when(kind.isin("id", "access"), "id").when(kind == "host", "host").otherwise("key")
    rows = parts.dropDuplicates(["row_key"]).select("row_key", F.explode(F.concat("base", "weak", "breaks")).alias("part"))
    onward = Window.partitionBy("row_key").orderBy(start, F.col("part.order"), stop).rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy("row_key").orderBy(start.desc(), F.col("part.order").desc(), stop.desc()).rowsBetween(Window.unboundedPreceding, -1)
    base, weak = F.col("part.order") < len(BASE), (F.col("part.order") >= len(BASE)) & (kind != BREAK[0])
    seen = rows.withColumns({
        "reach": F.max(F.when(base, stop)).over(onward), "scope": F.count(F.when(kind == BREAK[0], 1)).over(onward),
        "next": F.min(F.when(base, start)).over(back),
    })
    apart = (F.coalesce("reach", F.lit(0)) <= start) & (F.col("next").isNull() | (F.col("next") >= stop))
    return seen.filter(base | (weak & apart)).select("row_key", "scope", "part", weak.alias("weak"), role.alias("role"), start.alias("start"), stop.alias("stop"))


def linked_spans(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """(row_key, linked): the weak parts with a complementary part in their paragraph, within ``reach`` code points.

    ``parts`` has row_key, base, weak and breaks. An identifier, a secret and an
    endpoint complement each other; access keys count as identifiers, other
    base matches as secrets. Parts that overlap are no pair. The parts of a scope
    meet in blocks of ``reach`` code points, so a part is compared only with
    the few in its own neighbourhood, however long the document is.
    """
    rows = scoped_parts(parts)
    # A weak part looks for others in every block that it could reach, another is listed in every block it touches.
    blocks = lambda low, high: F.explode(F.sequence(F.floor(low / reach), F.floor(high / reach))).alias("block")
    left = rows.filter("weak").select("row_key", "scope", "part", "role", blocks(F.col("start") - reach, F.col("stop") + reach))
    right = rows.select("row_key", "scope", F.col("role").alias("other"), "start", "stop", blocks(F.col("start"), F.col("stop") - 1))
    right = right.groupBy("row_key", "scope", "block", "other").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("there"))

    def near(r: Column) -> Column:
        apart = (r["stop"] <= F.col("part.start")) | (F.col("part.stop") <= r["start"])
        return apart & (r["start"] < F.col("part.stop") + reach) & (F.col("part.start") < r["stop"] + reach)

    hits = left.join(right, ["row_key", "scope", "block"]).filter((F.col("role") != F.col("other")) & F.exists("there", near))
    return hits.groupBy("row_key").agg(F.array_sort(F.collect_set("part")).alias("linked"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def row_key(doc_id: Column, text: Column) -> Column:
    """Names a row by its content; rows that share it have the same spans."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("none")), F.sha2(text, 256))


def scan(documents: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id, counts of the base kinds, base spans and all spans of every document.

    Spans are (start, order, kind, stop) in code points, by start and kind.
    No text counts as empty and has none; repeated rows get the same spans, an
    empty table gives an empty result, and columns other than doc_id and text
    are ignored. Texts are scanned once; only spans move.
    """
    rows = with_parts(documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), F.col("text"))
    counts = [F.size(f"s_{kind}").cast("long").alias(f"n_{kind}") for kind, *_ in BASE]
    key = F.when(linkable(), row_key(F.col("doc_id"), F.col("text")))
    rows = materialize(rows.select("doc_id", *counts, "base", "weak", "breaks", key.alias("row_key")), "secret-parts")
    open_rows = rows.filter("row_key is not null")
    joined = open_rows.join(linked_spans(open_rows, reach), "row_key", "left")
    spans = F.when(F.col("linked").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "linked")))
    names = ["doc_id", *(f"n_{kind}" for kind, *_ in BASE), "base"]
    plain = rows.filter("row_key is null").select(*names, F.col("base").alias("spans"))
    return plain.unionByName(joined.select(*names, spans.alias("spans")))


def digests(found: DataFrame) -> DataFrame:
    """The spans of ``scan`` as strings, the base spans as a digest."""
    return found.select(
        "doc_id", *(f"n_{kind}" for kind, *_ in BASE),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
    )


def _redacted(text: Column, spans: Column, mask: str, block: int = 128) -> Column:
    """``text`` with the mask for every span; a span that overlaps the ones before it only extends them.

    Pieces are cut out of the stretch of text of some spans, not out of the whole text each, and joined once.
    """
    def pieces(spans: Column) -> Column:
        return let(running(F.transform(spans, lambda s: s["stop"]), F.greatest), lambda ends: built(spans, ends))

    def built(spans: Column, ends: Column) -> Column:
        n = F.size(spans)
        before = F.slice(F.concat(F.array(F.lit(0)), ends), F.lit(1), n)
        free = F.filter(F.zip_with(before, spans, lambda at, s: F.struct(at.alias("at"), s["start"].alias("start"))), lambda s: s["start"] >= s["at"])
        rest = F.substring(text, F.get(ends, n - 1) + 1, F.length(text))
        return F.concat(let(free, lambda free: F.array_join(F.transform(
            F.sequence(F.lit(0), F.floor((F.size(free) - 1) / block).cast("int")), lambda i: stretch(F.slice(free, i * block + 1, F.lit(block)))
        ), "")), rest)

    def stretch(group: Column) -> Column:
        first, last = F.get(group, F.lit(0))["at"], F.get(group, F.size(group) - 1)["start"]
        return let(F.substring(text, first + 1, last - first), lambda part: F.array_join(F.transform(
            group, lambda s: F.concat(F.substring(part, s["at"] - first + 1, s["start"] - s["at"]), F.lit(mask))
        ), ""))

    return F.when(F.size(spans) > 0, let(spans, pieces)).otherwise(text)


def redact(documents: DataFrame, mask: str = "[secret]", reach: int = REACH) -> DataFrame:
    """The documents with every span replaced by ``mask``; ``n_chars``, if there, follows the text.

    Texts are scanned once, their spans written beside them; only documents with
    several parts, one of them weak, are shuffled.
    """
    whole, columns = private(documents, "_row"), documents.columns
    packed = documents.select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.struct(*(F.col(f"`{c}`") for c in columns)).alias(whole)
    )
    rows = with_parts(packed, F.col("text"))
    key = F.when(linkable(), row_key(F.col("doc_id"), F.col("text")))
    rows = materialize(rows.select(whole, "text", "base", "weak", "breaks", key.alias("row_key")), "secret-parts")
    open_rows = rows.filter("row_key is not null")
    plain = rows.filter("row_key is null").select(whole, "text", F.col("base").alias("spans"))
    spans = F.when(F.col("linked").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "linked")))
    joined = open_rows.join(linked_spans(open_rows.select("row_key", "base", "weak", "breaks"), reach), "row_key", "left")
    joined = joined.select(whole, "text", spans.alias("spans"))
    out = plain.unionByName(joined).withColumn("text", _redacted(F.col("text"), F.col("spans"), mask))
    changed = F.when(F.size("spans") > 0, F.col("text")).otherwise(F.col(whole)["text"])
    fields = {c: F.col(whole)[c] for c in columns} | {"text": changed}
    if "n_chars" in fields:
        fields["n_chars"] = F.when(F.size("spans") > 0, F.length("text").cast(documents.schema["n_chars"].dataType)).otherwise(fields["n_chars"])
    return out.select(*(fields[c].alias(c) for c in columns))
