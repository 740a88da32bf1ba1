"""Secret scans with linking of multipart credentials.

Three kinds of base spans are always reported: ``assign`` (a named value of 8 or more characters), ``access`` (an access
identifier) and ``hex`` (a long run of hexadecimal digits).  Weak candidates, that alone mean little, are reported only
where complementary parts of a credential co-occur within ``scope`` code points: ``login`` (a named identifier) near a
secret, ``short`` (a named value below 8 characters) and ``key`` (a bare token of 40 characters) near an identifier, and
``endpoint`` (a URL) near both.  Parts of a document are put into cells as wide as the scope, each cell keeps the
smallest start and largest end of each class, and every candidate joins the cells that its scope touches: an interval
join whose size is linear in the number of parts.

Matches are found with regular expression functions: a marker is put around every match, the text is cut at the markers,
and the lengths of the pieces give the places.  All places are in code points, ends exclusive.

Edge cases: a null text counts as empty.  A null id is an id like any other.  Rows of equal id and text get equal
results.  Empty tables give empty tables; columns other than id and text are ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm import common

# The base patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
LOGIN = r"""(?i)(?:user(?:name)?|login|client_?id|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
KEY = r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"
# Lower-case words, one of which every match holds.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LOGIN_WORDS = ("user", "login", "clientid", "client_id", "keyid", "key_id")
ENDPOINT = r"""https?://[^\x20\x09-\x0D"'<>]+"""

# Kind: pattern, class of the part, and the classes that have to be near (none: a base span).
IDENTIFIER, SECRET, PLACE = "identifier", "secret", "place"
KINDS = {
    "assign": (ASSIGN, SECRET, ()), "access": (ACCESS, IDENTIFIER, ()), "hex": (HEX, SECRET, ()),
    "login": (LOGIN, IDENTIFIER, (SECRET,)), "key": (KEY, SECRET, (IDENTIFIER,)),
    "short": (ASSIGN, SECRET, (IDENTIFIER,)), "endpoint": (ENDPOINT, PLACE, (IDENTIFIER, SECRET)),
}
ORDER = list(KINDS)
BASE = [kind for kind, (_, _, near) in KINDS.items() if not near]
MARK = "\x01"
CHUNK = 64


def _cut(pattern: str) -> Column:
    """Matches at odd places, what lies between them at even ones."""
    return F.split(F.regexp_replace("text", pattern, MARK + "$0" + MARK), MARK)


def _places(df: DataFrame, name: str) -> DataFrame:
    """Turn the pieces in ``name`` into an array of (start, end, value) of the matches.

    Running sums in two levels: over chunks of 64 pieces, then inside a chunk.  The arrays are columns of their own and
    named twice in each expression, so that no lambda computes them anew."""
    rest = [c for c in df.columns if c != name]
    df = df.select(*rest, name, F.when(F.size(name) > 1, F.transform(name, F.length)).alias("n"))
    total = "(acc, x) -> acc + x"
    df = df.select(*rest, name, "n", F.expr(
        f"transform(sequence(0, (size(n) - 1) div {CHUNK}), c -> aggregate(slice(n, cast(c * {CHUNK} + 1 as int), {CHUNK}), 0, {total}))").alias("m"))
    df = df.select(*rest, name, "n", "m", F.expr(
        f"transform(sequence(0, size(m) - 1), c -> aggregate(slice(m, 1, c), 0, {total}))").alias("before"))
    start = f"before[cast(i div {CHUNK} as int)] + aggregate(slice(n, cast(i - i % {CHUNK} + 1 as int), i % {CHUNK}), 0, {total})"
    return df.select(*rest, F.expr(f"""
        coalesce(if(size({name}) < 3, null, transform(sequence(1, size(n) - 2, 2), i ->
            named_struct('start', {start}, 'end', {start} + n[i], 'value', {name}[i]))),
            cast(array() as array<struct<start: int, end: int, value: string>>))""").alias(name))


def parts(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, tag, and for each kind an array of (start, end)) for every row.

    A pattern only runs on texts that have a word it begins with; weak kinds only where the document has parts that they
    could complement.
    """
    text = F.coalesce(df[text_column].cast("string"), F.lit(""))
    # The marker becomes another character that no pattern takes, so no length changes.
    out = df.select(df[id_column].alias("id"), F.xxhash64(text).alias("tag"), F.translate(text, MARK, "\x02").alias("text"),
                    F.lower(text).alias("lower"))
    holds = lambda column, words: reduce(or_, (F.contains(column, F.lit(w)) for w in words))
    out = out.select("id", "tag", "text",
                     F.when(holds("lower", ASSIGN_WORDS), _cut(ASSIGN)).alias("assign"),
                     F.when(holds("text", ["AKIA"]), _cut(ACCESS)).alias("access"), _cut(HEX).alias("hex"),
                     F.when(holds("lower", LOGIN_WORDS), _cut(LOGIN)).alias("login"))
    for kind in ("assign", "access", "hex", "login"):
        out = _places(out, kind)
    some = lambda *kinds: reduce(or_, (F.size(k) > 0 for k in kinds))
    out = _places(out.select("*", F.when(some("access", "login"), _cut(KEY)).alias("key")), "key")
    out = _places(out.select("*", F.when(some("access", "login") & some("assign", "hex", "key"), _cut(ENDPOINT))
                             .alias("endpoint")), "endpoint")
    long = lambda m: F.length(F.regexp_extract(m["value"], ASSIGN, 2)) >= 8
    out = out.select("id", "tag", F.filter("assign", long).alias("assign"),
                     F.filter("assign", lambda m: ~long(m)).alias("short"), *[k for k in ORDER if k not in ("assign", "short")])
    bare = lambda array: F.transform(array, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))
    return out.select("id", "tag", *[bare(kind).alias(kind) for kind in ORDER])


def _merged(kinds: list[str]) -> Column:
    """The spans of several kinds in one array of (start, kind, end)."""
    def named(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(ORDER.index(kind)).alias("kind"),
                                                    s["end"].alias("end")))
    return F.concat(*map(named, kinds))


def linked(found: DataFrame, scope: int) -> DataFrame:
    """(id, tag, weak): the weak candidates with complementary parts in their scope."""
    sized = lambda kinds: sum((F.size(k) for k in kinds), F.lit(0))
    weak = [k for k in ORDER if k not in BASE]
    several = sum(((sized([k for k in ORDER if KINDS[k][1] == c]) > 0).cast("int") for c in (IDENTIFIER, SECRET, PLACE)),
                  F.lit(0))
    some = found.where((sized(weak) > 0) & (several > 1)).dropDuplicates(["id", "tag"])
    rows = some.select("id", "tag", F.explode(_merged(ORDER)).alias("p")).select("id", "tag", "p.*")
    classes = F.array(*[F.lit(KINDS[k][1]) for k in ORDER])
    rows = rows.withColumn("class", F.element_at(classes, F.col("kind") + 1))
    cell = lambda first, last: F.explode(F.sequence(F.floor(first / scope), F.floor(last / scope)))
    cells = (rows.select("id", "tag", "class", "start", "end", cell(F.col("start"), F.col("end")).alias("cell"))
             .groupBy("id", "tag", "class", "cell").agg(F.min("start").alias("first"), F.max("end").alias("last"))
             .select(F.col("id").alias("i"), F.col("tag").alias("t"), F.col("class").alias("near"),
                     F.col("cell").alias("c"), "first", "last"))
    low, high = F.greatest(F.col("start") - scope, F.lit(0)), F.col("end") + scope
    needs = F.create_map(*[x for k in weak for x in (F.lit(ORDER.index(k)), F.array(*map(F.lit, KINDS[k][2])))])
    asked = rows.where(F.col("kind").isin([ORDER.index(k) for k in weak])).select(
        "*", needs[F.col("kind")].alias("needs"), cell(low, high).alias("cell"))
    near = asked.join(cells, F.col("id").eqNullSafe(F.col("i")) & (F.col("tag") == F.col("t")) & (F.col("cell") == F.col("c"))
                      & (F.col("first") <= high) & (F.col("last") >= low) & F.array_contains("needs", F.col("near")))
    return (near.groupBy("id", "tag", "kind", "start", "end", "needs").agg(F.count_distinct("near").alias("met"))
            .where(F.col("met") == F.size("needs")).groupBy(F.col("id").alias("i"), F.col("tag").alias("t"))
            .agg(F.collect_list(F.struct("start", "kind", "end")).alias("weak")))


def scan(df: DataFrame, scope: int = 200, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column``, ``tag`` (a hash of the text), ``n_<kind>`` of the base kinds, and ``base`` and ``found``: arrays of
    (start, kind, end) with kind a place in ORDER, sorted."""
    # Stored, so that no pattern runs twice: the spans are small, and predicates on them stay behind the scan.
    found = common.stored(parts(df, id_column, text_column), "parts")
    out = found.select("id", "tag", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in BASE],
                       F.sort_array(_merged(BASE)).alias("base"))
    out = out.join(linked(found, scope), F.col("id").eqNullSafe(F.col("i")) & (F.col("tag") == F.col("t")), "left")
    every = F.sort_array(F.concat("base", F.coalesce("weak", F.slice("base", 1, 0))))
    return out.select(F.col("id").alias(id_column), "tag", *[f"n_{k}" for k in BASE], "base", every.alias("found"))


def as_text(spans: str) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, ORDER))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(df: DataFrame, scope: int = 200, id_column: str = "doc_id", text_column: str = "text",
           replacement: str = "[SECRET]") -> DataFrame:
    """``df`` with every span replaced in its texts; spans that overlap become one.  All rows and columns stay."""
    found = (scan(df, scope, id_column, text_column).where(F.size("found") > 0)
             .select(F.col(id_column).alias("__id"), F.col("tag").alias("__tag"), F.col("found").alias("__found"))
             .dropDuplicates(["__id", "__tag"]))
    found = common.stored(found, "secrets")  # its true size decides how it is joined
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    joined = df.join(found, F.col(id_column).eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__tag")), "left")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, s: F.struct(
        F.greatest(acc["at"], s["end"]).alias("at"),
        F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(
            acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(replacement))).alias("out"))
    clean = F.aggregate("__found", start, step, lambda acc: F.concat(
        acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return joined.select(*[F.when(F.col("__found").isNull(), F.col(text_column)).otherwise(clean).alias(c)
                           if c == text_column else F.col(c) for c in df.columns])
