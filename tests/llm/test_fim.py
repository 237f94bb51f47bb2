"""Fill-in-middle: against plain slices, and back again."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tickerloom.llm import fim


def brute(doc_id, text, units, seed="1"):
    text = text or ""
    u = units(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(u), "plain", None, None, None, text
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = ("".join(x) for x in (u[:a], u[a:b], u[b:]))
    spm = h[3] % 100 < 20
    return len(u), "spm" if spm else "psm", p, m, s, f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


AWKWARD = [
    "", None, "a", "\x01", "\x02", "\x02e\x02d\x01\x01ed", "<P", "a<S>b", "<M>", "<<S>>P>", "S>M>P>", "x\r\ny z\n", "é́ 𝒳𝒴 👩‍👩‍👧", "$0 \\1 $", "\x00\x00",
    " lead", "tail \t", "<" * 9, "<S" * 5, "ab " * 20_000,
]


@pytest.mark.parametrize("unit", ["CODE_POINT", "WORD_AND_SPACE"])
def test_transform_equals_slices_and_restores(spark, unit):
    rng = random.Random(4)
    rows = [(i, t) for i, t in enumerate(AWKWARD)] + [(None, "no id"), (7, "same id"), (7, "same id")]
    rows += [(100 + i, "".join(rng.choice("ab \n<SPM>\x01\x02de𝒳é") for _ in range(rng.randint(0, 30)))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(7) for c in ("n", "m", "form", "prefix", "output", "TEXT_")})
    form = fim.Form(unit=getattr(fim, unit))
    units = list if unit == "CODE_POINT" else lambda t: re.findall(r"[^ \t-\r]+[ \t-\r]*|[ \t-\r]+", t)
    made = fim.transform(df, form)
    got = made.withColumn("back", fim.restore(F.col("output"), F.col("form"), form)).collect()
    want = sorted((repr((i, t or "")), *map(repr, brute(i, t, units)), repr(t or "")) for i, t in rows)
    assert sorted((repr((r.doc_id, r.text)), *map(repr, (r.n, r.form, r.prefix, r.middle, r.suffix, r.output)), repr(r.back)) for r in got) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_digests_are_of_the_outputs(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(AWKWARD)], "doc_id long, text string")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in fim.digests(df).collect():
        text = AWKWARD[r.doc_id] or ""
        n, form, p, m, _, output = brute(r.doc_id, text, list)
        assert (r.n, r.form, r.output_sha256, r.restored_sha256) == (n, form, sha(output), sha(text))
        assert (r.prefix_chars, r.middle_chars) == ((None, None) if p is None else (len(p), len(m)))


def test_fim_of_no_rows_and_other_rates(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(300)], "doc_id long, text string")
    assert fim.digests(df.limit(0)).collect() == []
    assert {r.form for r in fim.transform(df, fim.Form(fim_rate=0)).collect()} == {"plain"}
    assert {r.form for r in fim.transform(df, fim.Form(fim_rate=100, spm_rate=100)).collect()} == {"spm"}


def test_fim_shuffles_nothing_and_runs_no_python(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = fim.digests(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
