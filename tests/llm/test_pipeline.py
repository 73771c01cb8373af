import brute
import corpus_pipeline as cp
from millrace.llm import common
from oracle import duck

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    """Each stage against plain Python, on its own input."""
    common.bound_batches(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, f in cp.STAGES:
        out.append(common.stage(f(spark, out[-1], SF), f"test-{name}"))
    quality, near, bench, secrets, tokens = [[(r.doc_id, r.text) for r in x.select("doc_id", "text").collect()] for x in out[1:5]] + [out[5].collect()]
    assert out[4].columns == docs.columns and len(quality) > 0.5 * docs.count()
    assert sorted(i for i, _ in near) == sorted(i for i, _, c in brute.op5(quality, cp.SHINGLE, cp.PERCENT) if i == c)
    hit = {x[0] for x in brute.op8(near, duck(SF, "select item_id, text from benchmark")[1]) if x[2]}
    assert sorted(i for i, _ in bench) == sorted(i for i, _ in near if i not in hit)
    found = {x[0] for x in brute.op1(bench) if sum(x[1:4])}
    before = dict(bench)
    assert len(secrets) == len(bench) and {i for i, t in secrets if t != before[i]} >= found
    assert not any(sum(x[1:4]) for x in brute.op1(secrets))
    assert sorted((r.doc_id, r.decoded_sha256) for r in tokens) == sorted((i, brute.sha(t)) for i, t in secrets)


def test_odd_rows(spark):
    common.bound_batches(spark)
    texts = [None, "", "a b", "a b", "x " * 5000, 'token: "abcdefgh"']
    df = spark.createDataFrame([(k % 4, t, "en", "s", 1, "extra") for k, t in enumerate(texts)] + [(None, "null id", "en", "s", 1, "extra")], "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string")
    assert cp.near_duplicates(spark, df, SF).columns == df.columns
    assert cp.secrets(spark, df, SF).where("text like '%SECRET%'").count() == 1
    assert cp.benchmark(spark, df, SF).count() == df.count()
    for f in (cp.quality, cp.tokens):
        out = f(spark, df, SF)
        assert (out.columns == df.columns) if f is cp.quality else out.count() == df.count()
    kept = cp.quality(spark, df, "/root/testdata/sf0.01")  # rows with equal texts have equal fates
    fate = {t: {r.text for r in kept.collect() if r.text == t} != set() for t in texts}
    assert kept.count() == sum(fate[t] for t in texts) + (kept.where("text = 'null id'").count())
    assert sorted((str(r.doc_id), r.n_tokens > 0) for r in cp.tokens(spark, df, SF).collect()) == sorted([(str(k % 4), bool(t)) for k, t in enumerate(texts)] + [("None", True)])
    empty = df.limit(0)
    for _, f in cp.STAGES:
        assert f(spark, empty, SF).count() == 0


def test_near_duplicates_by_row(spark):
    """Repeated and null ids, against brute force over the rows."""
    common.bound_batches(spark)
    base = [f"w{k}" for k in range(100)]
    near = lambda k, w=base: " ".join(x if j != k else f"n{k}" for j, x in enumerate(w))
    own = lambda k: " ".join(f"o{k}x{j}" for j in range(30))
    other = [f"u{k}" for k in range(100)]
    rows = [(1, near(1)), (2, near(2)), (2, own(0)), (3, own(1)), (3, own(2)), (None, near(3)), (None, own(3)), (None, own(4)), (None, own(4)), (5, near(1, other)), (5, near(2, other)),
            (None, near(5, [x + "n" for x in other])), (None, near(6, [x + "n" for x in other])), (7, None), (7, ""), (8, ""), (None, ""), (None, None), (9, own(5)), (9, own(5)), (9, own(6))]
    df = spark.createDataFrame([(i, t, "extra") for i, t in rows], "doc_id bigint, text string, fp string")
    out = cp.near_duplicates(spark, df, SF)
    assert out.columns == df.columns
    hashes = {r.text: r.h for r in df.select("text", cp.text_key(df).alias("h")).collect()}
    keys = sorted({(i is None, i or 0, hashes[t]) for i, t in rows})
    ranked = [(keys.index((i is None, i or 0, hashes[t])), t) for i, t in rows]
    stay = {i for i, _, c in brute.op5(ranked, cp.SHINGLE, cp.PERCENT) if i == c}
    assert sorted((r.doc_id is None, r.doc_id or 0, hashes[r.text]) for r in out.collect()) == [keys[k] for k in sorted(stay)]
