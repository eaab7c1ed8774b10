import numpy as np
import pytest
from pyspark.sql import functions as F

from weirflow.llm import language_id
from weirflow.llm.queries import op1_language_id

SF = "/root/testdata/sf0.01"
SCHEMA = "text string, lang string, host string, suffix string"
LETTERS = "bcdfghjklmnpqrstvwxz"


def words(k):
    """Words of an invented language: no two share a trigram within a word."""
    a, b = LETTERS[k % 20], LETTERS[k // 20]
    return " ".join(f"{a}{v}{b}{v}{a}" for v in "aeiou") * 3


def test_rare_and_many_languages_are_answers(spark):
    tags = [f"{a}{b}" for a in "abcdefgh" for b in "abcdefghij"]  # 80 of them, one of them in one row of 3000
    rows = [(words(0), tags[0], None, None)] * 3000 + [(words(k), t, None, None) for k, t in enumerate(tags) if k]
    out = language_id.identify(spark.createDataFrame(rows, SCHEMA), declared_col="lang", host_col=None).select("lang", "language.*").distinct().collect()
    assert {r.lang: r.code for r in out} == {t: t for t in tags} and all(r.kept for r in out)


def test_languages_of_too_little_text_are_reported(spark):
    rows = [(words(0), "aa", None, None)] * 20 + [("zq", "zz", None, None)]
    with pytest.warns(RuntimeWarning, match="no answers: zz"):
        out = language_id.identify(spark.createDataFrame(rows, SCHEMA), host_col=None).select("language.code").distinct().collect()
    assert [r.code for r in out] == ["aa"]


def test_suffixes_beyond_the_limit_share_a_likelihood(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_SUFFIXES", 1)
    rows = [(words(0), "aa", None, "com")] * 100 + [(words(1), "bb", None, f"s{k % 50}") for k in range(100)] + [("yy", None, None, "s7"), ("yy", None, None, "com")]
    out = language_id.identify(spark.createDataFrame(rows, SCHEMA), host_col=None, suffix_col="suffix").filter(F.col("text") == "yy").select("suffix", "language.code").collect()
    assert {r.suffix: r.code for r in out} == {"s7": "bb", "com": "aa"}


def test_signs_are_no_letters(spark):
    texts = ["—— … ———", "\u00a0«»\u00a0", "1234 %% --", "😀😀 ☃", "、。「」"]
    rows = [("the cat and the dog sat there", "en", None, None)] * 5 + [(t, "en", None, None) for t in texts] + [("“été” — ñandú", None, None, None)]
    out = {r.text: r for r in language_id.identify(spark.createDataFrame(rows, SCHEMA), host_col=None).select("text", "language.*").collect()}
    assert all((out[t].code, out[t].confidence, out[t].trigrams, out[t].kept) == ("und", 0.0, 0, False) for t in texts)
    assert out["“été” — ñandú"].trigrams == (5 + 2) + (7 + 1)  # bytes, and blanks around them that a trigram may reach


def test_posterior_by_hand(spark):
    """The four kinds of evidence, fused as one plain computation fuses them."""
    rng = np.random.default_rng(5)
    langs, rows = ["aa", "bb", "cc"], []
    for k in range(90):
        lang = k % 3
        text = " ".join(rng.choice([w for x in (words(lang), words(3)) for w in x.split()], 4))
        rows.append((text, langs[lang] if k % 4 else None, f"h{k % 5}.d{k % 2}.{('org', 'com')[k % 2]}" if k % 6 else None, ("org", "com")[k % 2] if k % 6 else None))
    got = language_id.identify(spark.createDataFrame(rows, SCHEMA).coalesce(1), "text", "lang", "host", "suffix").select("text", "lang", "host", "suffix", "language.*").collect()

    def grams(text):
        return np.bincount(language_id.trigrams(text), minlength=language_id.BUCKETS)

    counts = np.full((3, language_id.BUCKETS), 0.5)
    for text, lang, *_ in rows:
        if lang:
            counts[langs.index(lang)] += grams(text)
    logs = np.log(counts / counts.sum(1, keepdims=True))
    shown = []
    for text, *_ in rows:
        s = language_id.TEMPER * (logs @ grams(text))
        shown.append((s, np.exp(s - s.max()) / np.exp(s - s.max()).sum()))
    domain = lambda host: ".".join(host.split(".")[-2:]) if host else ""

    def sums(values):
        out = {}
        for v, (_, p) in zip(values, shown, strict=True):
            if v is not None:
                out[v] = out.get(v, 0) + p
        return out

    def likelihoods(values):
        by = sums(values)
        whole = sum(by.values())
        return {v: np.log((n + 0.5) / (whole + 0.5 * (len(by) + 1))) for v, n in by.items()}

    declared, suffix = likelihoods([r[1] for r in rows]), likelihoods([r[3] for r in rows])
    by_host, by_domain = sums([r[2] for r in rows]), sums([domain(r[2]) for r in rows])
    whole = sum(p for _, p in shown)
    corpus = (whole + 1) / (whole.sum() + 3)
    for (text, lang, host, end), (s, _), r in zip(rows, shown, got, strict=True):
        prior = corpus
        if host:
            for n, weight in ((by_domain[domain(host)], language_id.DOMAIN_WEIGHT), (by_host[host], language_id.HOST_WEIGHT)):
                prior = (prior * weight + n) / (n.sum() + weight)
        post = s + np.log(prior) + (declared[lang] if lang else 0) + (suffix[end] if end else 0)
        post = np.exp(post - post.max()) / np.exp(post - post.max()).sum()
        assert (r.text, r.code) == (text, langs[int(post.argmax())])
        assert abs(r.confidence - post.max()) < 2e-6


def test_query_covers_documents_and_pages(spark):
    out = op1_language_id(spark, SF).cache()
    for kind, key in (("document", "doc_id"), ("page", "page_id")):
        rows = out.filter(F.col("kind") == kind)
        table = spark.read.parquet(f"{SF}/{kind}s.parquet")
        assert rows.count() == table.count() and rows.join(table, key, "left_anti").count() == 0
        named = rows.filter("declared <> ''").select("declared", "code").collect()
        assert named and sum(r.code == r.declared.lower()[:2] for r in named) > 0.9 * len(named)
