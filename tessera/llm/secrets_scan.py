"""Secret scans with corpus-wide ownership frequency.

Base findings are three kinds of matches. The scan also proposes further candidates (vendor tokens, signed
web tokens, credentials in URLs, key headers, mixed-class strings). Candidate values are hashed, and each
hash is counted by distinct repositories and distinct owners over the whole corpus. A value that many owners
have is a widely copied example; one that few have looks live. Further candidates become findings only when
they look live and touch no base finding; base findings always stay.

Defined cases: null text counts as empty; a null repository or owner is one of its own; repeated rows each
return a row, and count once per owner; tables without rows give none; ties in start go by kind; a very long text
takes time in proportion to its length; further columns, whatever their names, pass redact() and are not read by
find(). A hash that a third of all rows share is pre-aggregated before it is shuffled, and its rows are joined
back in SALTS parts.
"""

from __future__ import annotations

import bisect
import itertools
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from tessera.llm.common import materialize, packed, text_of, texts

#: Parts in which the rows of a hot hash are joined, most hot hashes, matches that a hash must have to be hot.
SALTS, MOST_HOT, LEAST_HOT = 256, 1000, 1000
KEY_NAME = r"[A-Z ]{0,30}PRIVATE KEY"
#: A key's body: up to the END line of the same name; else (a key cut short) header fields and runs of base64 as far as they go.
KEY_BODY = rf"""-----BEGIN ({KEY_NAME})-----(?:((?:[^-]|-(?!----))*+)-----END \1-----|((?:\s*+[A-Z][A-Za-z]*+-[A-Za-z]++:(?:[^\r\n-]|-(?!----))*+)*+(?:(?:\s|\\[nr])*+[A-Za-z0-9+/]{{16,}}+={{0,2}})++))?"""
#: Fixed patterns of the base kinds, in their order: kind, pattern, the group that must be long enough, its least length.
BASE = (
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE, 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 0, 18),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{16,}", 0, 0, 16),  # the runs of [0-9a-f]+ that are long enough
)
#: Further candidates, in their order.
MORE = (
    ("vendor", r"(?:gh[pousr]_|sk_live_|xox[abprs]-|glpat-)[A-Za-z0-9_-]+", 0, 0, 20),
    ("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++", 0, 0, 30),
    ("url", r"[a-z][a-z0-9+.-]{1,15}://[^\s/:@]++:[^\s/@]++@", 0, 0, 12),
    ("pem", KEY_BODY, 0, 0, 20),
    ("mixed", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}", 0, 0, 24),
)
#: What a text must hold in lower case for a match of the kind to be possible; kinds without are always looked for.
HINTS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("akia",), "vendor": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk_live_", "xox", "glpat-"),
    "jwt": ("eyj",), "url": ("://",), "pem": ("private key",),
}
KINDS = tuple(k for k, *_ in (*BASE, *MORE))
CLASSES = (re.compile("[a-z]"), re.compile("[A-Z]"), re.compile("[0-9]"))
COMPILED = tuple((k, re.compile(p, flags | re.ASCII), group, least) for k, p, flags, group, least in (*BASE, *MORE))


def key_of(m: re.Match) -> str:
    """What tells one key from another: its body, without line ends, quotes and indents; the header where there is no body."""
    return re.sub(r"\\[nr]|[^A-Za-z0-9+/=]", "", m.group(2) or m.group(3) or "") or m.group(0)


def matches(text: str, kinds: int = len(KINDS)) -> list[tuple[int, int, int, str]]:
    """(start, end, kind number, secret value) of all candidates of the first `kinds` kinds in a text, by start, then kind; further ones that touch an earlier one are left out.

    A key block may hold other candidates (a salt in hex, say); those before it in KINDS stay beside it. Matches of
    one kind never touch, so each kind is compared with those before it, sorted once: time stays linear but for the sort.
    """
    out, low = [], text.lower()
    for k, (name, pattern, group, least) in enumerate(COMPILED[:kinds]):
        if name in HINTS and not any(hint in low for hint in HINTS[name]):
            continue
        found = []
        for m in pattern.finditer(text):
            value = m.group(group)
            if len(value) >= least and (name != "mixed" or all(c.search(value) for c in CLASSES)):
                found.append((*m.span(), k, key_of(m) if name == "pem" else value))
        if k >= len(BASE) and out and found:
            taken = sorted((a, b) for a, b, *_ in out)
            starts = [a for a, _ in taken]
            reach = list(itertools.accumulate((b for _, b in taken), max))

            def touches(a, b, whole):
                first, last = bisect.bisect_left(starts, a), bisect.bisect_left(starts, b)
                if whole:
                    return first > 0 and reach[first - 1] > a or any(taken[i][1] > b for i in range(first, last))
                return last > 0 and reach[last - 1] > a

            found = [x for x in found if not touches(x[0], x[1], name == "pem")]
        out += found
    return sorted(out)


def joined(spans) -> str:
    """kind:start:end of each, comma-joined."""
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k, *_ in spans)


CANDIDATE = StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("kind", IntegerType()), StructField("hash", LongType())])


def scan(docs: DataFrame, repository: str = "source", owner: str = "source") -> DataFrame:
    """doc_id, text_hash, repository, owner, counts of base kinds, base_sha256 and candidates of every whole text."""
    schema = StructType([
        StructField("doc_id", LongType()), StructField("text_hash", LongType()), StructField("repository", StringType()), StructField("owner", StringType()),
        *(StructField(f"n_{k}", LongType()) for k, *_ in BASE), StructField("base_sha256", StringType()), StructField("candidates", ArrayType(CANDIDATE)),
    ])

    def run(batches):
        import hashlib

        import pyarrow as pa
        import xxhash

        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            columns = [[] for _ in range(6)]
            for text in batch.column(1).to_pylist():
                text = text or ""
                found = matches(text)
                base = [x for x in found if x[2] < len(BASE)]
                row = [xxhash.xxh3_64_intdigest(text) - (1 << 63), *(sum(x[2] == k for x in base) for k in range(len(BASE)))]
                row += [hashlib.sha256(joined(base).encode()).hexdigest(), [{"start": a, "end": b, "kind": k, "hash": xxhash.xxh3_64_intdigest(v) - (1 << 63)} for a, b, k, v in found]]
                for column, value in zip(columns, row):
                    column.append(value)
            made = [batch.column(0), columns[0], batch.column(2), batch.column(3), *columns[1:]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, list) else c.cast(f.type) for c, f in zip(made, arrow)], schema=arrow)

    named = texts(docs, F.col(repository).cast("string").alias("repository"), F.col(owner).cast("string").alias("owner"))
    return named.mapInArrow(run, schema)


def ownership(scanned: DataFrame) -> DataFrame:
    """hash, n_repositories, n_owners and n_rows (matches) over the whole corpus; one row per hash. Every count is combined before its shuffle."""
    known = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")).alias(c)  # noqa: E731  null is none of the names
    found = scanned.select(F.explode("candidates.hash").alias("hash"), known("repository"), known("owner")).groupBy("hash", "repository", "owner").agg(F.count("*").alias("n"))
    repositories = found.groupBy("hash", "repository").agg(F.sum("n").alias("n")).groupBy("hash").agg(F.count("*").alias("n_repositories"), F.sum("n").alias("n_rows"))
    owners = found.groupBy("hash", "owner").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("*").alias("n_owners"))
    return repositories.join(owners, "hash")


def classified(scanned: DataFrame, max_owners: int) -> DataFrame:
    """key_id, key_hash and the spans (start, end, kind, live) of every text with candidates; one row per distinct (doc_id, text).

    A hash with more than one in MOST_HOT of all matches is hot (so fewer than MOST_HOT are); its rows are joined in SALTS parts.
    """
    texts_once = scanned.where(F.size("candidates") > 0).dropDuplicates(["doc_id", "text_hash"])
    spans = texts_once.select("doc_id", "text_hash", F.explode("candidates").alias("c")).select("doc_id", "text_hash", "c.*")
    live = (F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_owners)
    owned = materialize(ownership(scanned).select("hash", live.alias("live"), "n_rows"), "ownership")
    total = owned.agg(F.sum("n_rows")).collect()[0][0] or 0
    hot = [r["hash"] for r in owned.where(F.col("n_rows") > max(total // MOST_HOT, LEAST_HOT)).select("hash").collect()]
    is_hot = F.col("hash").isin(hot) if hot else F.lit(False)
    salted = spans.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(0))
    owned = owned.select("hash", "live", F.explode(F.sequence(F.lit(0).cast("long"), F.when(is_hot, SALTS - 1).otherwise(0).cast("long"))).alias("salt"))
    kept = F.sort_array(F.collect_list(F.struct("start", "kind", "end", "live")))
    return salted.join(owned, ["hash", "salt"]).groupBy(F.col("doc_id").alias("key_id"), F.col("text_hash").alias("key_hash")).agg(kept.alias("found"))


def find(docs: DataFrame, repository: str = "source", owner: str = "source", max_owners: int = 2) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_examples, findings of every document.

    spans: all findings as text; findings: the same as an array of (start, kind, end, live), kind by its place in
    KINDS; n_live and n_examples count candidates of either class. max_owners: the most distinct owners, and
    repositories, that a live-looking value has.
    """
    scanned = materialize(scan(docs, repository, owner), "secret-scan")
    found = classified(scanned, max_owners)
    joined_on = F.col("doc_id").eqNullSafe(F.col("key_id")) & (F.col("text_hash") == F.col("key_hash"))
    both = scanned.drop("candidates", "repository", "owner").join(found, joined_on, "left").withColumn("found", F.coalesce("found", F.expr("cast(array() as array<struct<start:int,kind:int,end:int,live:boolean>>)")))
    stays = F.filter("found", lambda x: x["live"] | (x["kind"] < len(BASE)))
    names = F.array(*map(F.lit, KINDS))
    shown = F.array_join(F.transform("findings", lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
    live = F.size(F.filter("found", lambda x: x["live"]))
    return both.withColumns({"findings": stays, "n_live": live, "n_examples": F.size("found") - live}).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", shown.alias("spans"), "n_live", "n_examples", "findings", "text_hash")


def redact(docs: DataFrame, repository: str = "source", owner: str = "source", max_owners: int = 2) -> DataFrame:
    """The documents with every finding replaced by [kind]; the columns stay, n_chars (where there is one) follows the text.

    Texts without further live findings, nearly all, are redacted as they are read; further live findings are few and join on (doc_id, text).
    """
    found = classified(materialize(scan(docs, repository, owner), "secret-scan"), max_owners)
    more = found.select("key_id", F.struct("key_hash", F.filter("found", lambda x: x["live"] & (x["kind"] >= len(BASE))).alias("spans")).alias("more")).where(F.size("more.spans") > 0)
    more = more.groupBy("key_id").agg(F.collect_list("more").alias("more"))
    rows = packed(docs)
    kind = rows.schema["row"]

    def run(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            row, new = batch.column(0), []
            for text, extra in zip(text_of(row).to_pylist(), batch.column(1).to_pylist()):
                if text is not None:
                    spans = matches(text, len(BASE))
                    if extra:
                        own = xxhash.xxh3_64_intdigest(text) - (1 << 63)
                        spans += [(x["start"], x["end"], x["kind"]) for e in extra if e["key_hash"] == own for x in e["spans"]]
                    spans.sort()
                    parts, here = [], 0
                    for a, b, k, *_ in spans:
                        if a >= here:
                            parts += [text[here:a], f"[{KINDS[k]}]"]
                        here = max(here, b)
                    text = "".join(parts) + text[here:]
                new.append(text)
            made = row.flatten()
            made[row.type.get_field_index("text")] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(made, [f.name for f in row.type])], ["row"])

    marked = rows.join(more, F.col("row.doc_id").eqNullSafe(F.col("key_id")), "left").select("row", "more")
    out = marked.mapInArrow(run, StructType([kind])).select("row.*")
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType))
