"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are multiplied: the text's letter trigrams, the language that its markup declares, the suffix of
its address, and a prior of its host that is smoothed towards the host's domain and that towards the whole corpus.
Everything is learned from the corpus: trigram counts by declared language, then, with the languages that the texts
show, how far declarations and suffixes can be trusted and which languages each host has, all by grouped aggregation
into tables keyed by language. Every declared language with some text can be an answer, however rare it is.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.llm.common import written

BUCKETS = 1 << 13
#: Trigrams that a declared language needs in all its texts to be an answer; those with fewer are reported.
MIN_TRIGRAMS = 30
#: Languages whose counts a task holds at once.
COUNT_LANGUAGES = 256
#: Address suffixes with a likelihood of their own; all others share one.
MAX_SUFFIXES = 1000
#: Shares of a language under this are lost in the rounding of the sums they go into.
LEAST_SHARE = 1e-12
#: Trigrams of a text overlap and depend on each other: so much of their evidence counts.
TEMPER = 0.3
#: Documents' worth of the level above in a host's and a domain's prior.
HOST_WEIGHT, DOMAIN_WEIGHT = 20.0, 50.0
#: Documents whose best language is less likely are rejected, as are those without any letters.
MIN_CONFIDENCE = 0.5

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[65:91] = _FOLD[97:123] = np.arange(97, 123)


def letters(raw: np.ndarray) -> np.ndarray:
    """The UTF-8 bytes with blanks for what are no letters: ASCII's other signs, and the blocks of punctuation, symbols and pictures.

    These are, by lead and second byte: C2 80-BF but for three letters, E2 80-AF, E3 80, EF B8-BB and F0 9F.
    """
    out = _FOLD[raw]
    lead = np.flatnonzero((raw == 0xC2) | (raw == 0xE2) | (raw == 0xE3) | (raw == 0xEF) | (raw == 0xF0))
    if len(lead):
        kind, second = raw[lead], raw[np.minimum(lead + 1, len(raw) - 1)]
        sign = (kind == 0xC2) & (second != 0xAA) & (second != 0xB5) & (second != 0xBA)
        sign |= (kind == 0xE2) & (second < 0xB0) | (kind == 0xE3) & (second == 0x80) | (kind == 0xEF) & (second >= 0xB8) & (second < 0xBC) | (kind == 0xF0) & (second == 0x9F)
        size = np.where(kind == 0xC2, 2, np.where(kind == 0xF0, 4, 3))
        for k in range(4):
            out[lead[sign & (size > k)] + k] = 32
    return out


def trigrams(text: str | None) -> np.ndarray:
    """Hash buckets of the trigrams of the text's lower-cased letters (other signs are blanks; ASCII case only)."""
    raw = letters(np.frombuffer(b" " + (text or "").encode() + b" ", np.uint8)).astype(np.int64)
    if len(raw) < 3:
        return np.zeros(0, np.int64)
    three = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
    return (three[(three != 0x202020)] * 0x9E3779B1 >> 15) & (BUCKETS - 1)


def primary(tag: Column) -> Column:
    """The language of a tag such as en-GB: its first part in lower case."""
    t = F.lower(F.regexp_extract(F.coalesce(tag, F.lit("")), "^[\\s]*([A-Za-z]{2,3})(?![A-Za-z])", 1))
    return F.when(t != "", t)


def page_evidence(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` with text, declared, host and suffix, from a page's address and markup; old columns of these names are replaced.

    A null page is an empty text that declares nothing (an empty string), a null or odd address has neither host nor suffix.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    bare = F.regexp_replace(html, "(?is)<(script|style)\\b.*?</\\1>|<[^>]*>", " ")
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return pages.withColumns({
        "text": bare,
        "declared": F.regexp_extract(html, "(?i)<html[^>]*\\blang\\s*=\\s*[\"']?([A-Za-z-]+)", 1),
        "host": F.when(host != "", host),
        "suffix": F.when(host.contains("."), F.substring_index(host, ".", -1)),
    })


def identify(docs: DataFrame, text_col: str = "text", declared_col: str | None = "lang", host_col: str | None = "source", suffix_col: str | None = None) -> DataFrame:
    """``docs`` with a struct column ``language``: code, confidence, trigrams, kept. A column of that name, in any case, is replaced.

    Evidence that is null or of a value never seen says nothing. A text without letters, null ones too, has the code
    "und", confidence 0, and is rejected (kept is false); so is one whose best language is less likely than
    MIN_CONFIDENCE. Ties go to the language that is first in the alphabet. Rows, repeated ones too, are judged each on
    its own, texts as wholes; an empty table gives an empty result. Where no language is declared anywhere all is "und".
    A declared language with fewer than MIN_TRIGRAMS trigrams is no answer, of which a RuntimeWarning tells.
    """
    spark = docs.sparkSession
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "language"])
    none = F.lit(None).cast("string")
    named = lambda c: F.lower(F.trim(F.col(c).cast("string"))) if c else none
    base = docs.select(
        own.alias("_doc"),
        F.col(text_col).alias("_text"),
        (primary(F.col(declared_col)) if declared_col else none).alias("_declared"),
        named(host_col).alias("_host"),
        named(suffix_col).alias("_suffix"),
    )
    base = base.withColumn("_domain", F.when(F.col("_host").rlike("\\..+\\."), F.substring_index("_host", ".", -2)).otherwise(F.lit("")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, n in held.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["lang", "bucket", "n"])
            held.clear()

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if lang not in held:
                    if len(held) == COUNT_LANGUAGES:
                        yield from rows()
                    held[lang] = np.zeros(BUCKETS, np.int64)
                held[lang] += np.bincount(trigrams(text), minlength=BUCKETS)
        yield from rows()

    cells = base.filter("_declared IS NOT NULL").select("_declared", "_text").mapInArrow(count, "lang string, bucket long, n long")
    cells, _ = written(cells.groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "language-trigrams")
    sizes = {r["lang"]: r["n"] for r in cells.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # a row a language
    langs = sorted(x for x, n in sizes.items() if n >= MIN_TRIGRAMS)
    if few := sorted(sizes.keys() - set(langs)):
        warnings.warn(f"language_id: declared languages with fewer than {MIN_TRIGRAMS} trigrams are no answers: {', '.join(few)}", RuntimeWarning, stacklevel=2)
    if not langs:
        return docs.drop("language").withColumn("language", F.struct(F.lit("und").alias("code"), F.lit(0.0).alias("confidence"), F.lit(0).cast("long").alias("trigrams"), F.lit(False).alias("kept")))
    place = {x: k for k, x in enumerate(langs)}
    counts = np.full((len(langs), BUCKETS), 0.5)
    for r in cells.toLocalIterator():  # at most BUCKETS rows a language
        if (k := place.get(r["lang"])) is not None:
            counts[k, r["bucket"]] += r["n"]
    sent = spark.sparkContext.broadcast(np.ascontiguousarray(np.log(counts / counts.sum(1, keepdims=True)).T))

    def likelihood(w: np.ndarray, text: str | None) -> tuple[np.ndarray, int]:
        t = trigrams(text)
        s = TEMPER * (np.bincount(t, minlength=BUCKETS) @ w) if len(t) > 64 else TEMPER * w[t].sum(0)
        return s - s.max(), len(t)

    # What the texts alone show, by declaration, suffix and host: soft counts of each language.
    keys = ["_declared", "_suffix", "_host", "_domain"]

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for b in batches:
            held: dict[tuple, np.ndarray] = {}
            for *key, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ll, n = likelihood(w, text)
                if n:
                    p = np.exp(ll)
                    p /= p.sum()
                    key = tuple(key)
                    held[key] = held[key] + p if key in held else p
            for from_key in range(0, len(held), 1000):
                some = list(held.items())[from_key : from_key + 1000]
                every = np.stack([p for _, p in some])
                row, lang = np.nonzero(every >= LEAST_SHARE)
                columns = [pa.array([k[j] for k, _ in some], pa.string()).take(pa.array(row)) for j in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(lang.astype(np.int32)), pa.array(every[row, lang])], [*keys, "lang", "p"])

    # Known languages only: every other declaration counts as one value.
    shown = F.when(F.col("_declared").isin(langs), F.col("_declared")).when(F.col("_declared").isNotNull(), F.lit("?")).alias("_declared")
    seen = base.select(shown, "_suffix", "_host", "_domain", "_text").mapInArrow(show, "_declared string, _suffix string, _host string, _domain string, lang int, p double")
    table, _ = written(seen.groupBy(*keys, "lang").agg(F.sum("p").alias("p")), "language-counts")

    def dense(rows: DataFrame) -> np.ndarray:
        out = np.zeros(len(langs))
        for r in rows.groupBy("lang").agg(F.sum("p").alias("p")).collect():  # a row a language
            out[r["lang"]] = r["p"]
        return out

    def likelihood_of(key: str, limit: int | None = None) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Logs of P(value | language) for the ``limit`` most frequent values, and the one that all others share."""
        by = table.filter(F.col(key).isNotNull())
        found = by.groupBy(key).agg(F.sum("p").alias("size"))
        if limit:
            found = found.orderBy(F.desc(F.round("size", 3)), key).limit(limit)
        sums = {r[key]: np.zeros(len(langs)) for r in found.select(key).collect()}
        for r in by.join(F.broadcast(found.select(key)), key).groupBy(key, "lang").agg(F.sum("p").alias("p")).collect():
            sums[r[key]][r["lang"]] = r["p"]
        whole = dense(by)
        under = whole + 0.5 * (len(sums) + 1)
        rest = np.maximum(whole - sum(sums.values(), np.zeros(len(langs))), 0)
        rest[rest < 1e-9 * whole] = 0
        return {v: np.log((n + 0.5) / under) for v, n in sums.items()}, np.log((rest + 0.5) / under) if rest.any() else np.zeros(len(langs))

    by_declared, by_suffix = likelihood_of("_declared"), likelihood_of("_suffix", MAX_SUFFIXES)
    whole = dense(table)
    corpus = (whole + 1) / ((whole.sum() or 1.0) + len(langs))

    def shares(by: str) -> DataFrame:
        """Soft counts of each value's languages, as a list."""
        sums = table.filter(F.col(by).isNotNull()).groupBy(by, "lang").agg(F.sum("p").alias("p"))
        return sums.groupBy(by).agg(F.collect_list("lang").alias(f"{by}_langs"), F.collect_list("p").alias(f"{by}_p"))

    def smooth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for _, host_langs, host_p, domain_langs, domain_p in zip(*(c.to_pylist() for c in b.columns), strict=True):
                prior = corpus
                for at, p, weight in ((domain_langs, domain_p, DOMAIN_WEIGHT), (host_langs, host_p, HOST_WEIGHT)):
                    prior = prior * weight
                    prior[at] += p
                    prior /= sum(p) + weight
                out.append(np.log(prior))
            ends = pa.array(np.arange(len(out) + 1, dtype=np.int32) * len(langs))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(out) if out else np.zeros(0)))], ["_host", "prior"])

    own_domain = table.filter("_host IS NOT NULL").select("_host", "_domain").distinct()
    hosts = own_domain.join(shares("_host"), "_host").join(shares("_domain"), "_domain").select("_host", "_host_langs", "_host_p", "_domain_langs", "_domain_p")
    hosts, _ = written(hosts.mapInArrow(smooth, "_host string, prior array<double>"), "language-hosts")
    told = spark.sparkContext.broadcast((by_declared, by_suffix, np.log(corpus)))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, (values, above) = sent.value, (told.value[:2], told.value[2])
        for b in batches:
            code, share, sizes = [], [], []
            prior = b.column("prior")
            ends, logs = prior.offsets.to_numpy(), prior.values.to_numpy()
            for k, (text, *said) in enumerate(zip(*(b.column(c).to_pylist() for c in ("_text", "_declared", "_suffix")), strict=True)):
                post, n = likelihood(w, text)
                for value, (known, other) in zip(said, values, strict=True):
                    if value is not None:
                        post = post + known.get(value, other)
                post = post + (logs[ends[k] : ends[k + 1]] if prior[k].is_valid else above)
                best = int(post.argmax())
                code.append(langs[best] if n else "und")
                share.append(1 / np.exp(post - post[best]).sum() if n else 0.0)
                sizes.append(n)
            yield pa.RecordBatch.from_arrays([b.column("_doc"), pa.array(code, pa.string()), pa.array(share, pa.float64()), pa.array(sizes, pa.int64())], ["_doc", "_code", "_conf", "_n"])

    rows = base.select("_doc", shown, "_suffix", "_host", "_text").join(hosts, "_host", "left").select("_doc", "_declared", "_suffix", "prior", "_text")
    out = rows.mapInArrow(judge, T.StructType([rows.schema["_doc"]]).add("_code", "string").add("_conf", "double").add("_n", "long"))
    out = out.withColumn("_conf", F.round("_conf", 6))
    return out.select(
        "_doc.*",
        F.struct(
            F.col("_code").alias("code"),
            F.col("_conf").alias("confidence"),
            F.col("_n").alias("trigrams"),
            ((F.col("_n") > 0) & (F.col("_conf") >= MIN_CONFIDENCE)).alias("kept"),
        ).alias("language"),
    )
