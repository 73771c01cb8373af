"""The registered queries of the operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe_transducer, chat_format, decontaminate, jaccard_join, quality_rules, secret_scan, sharding, toxicity, url_filter, zstd_quality
from .common import bound_batches, held_out, read

# Fixed values: (verdict, host, path).
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
# A conversation that holds control strings.
EXTRA_TURNS = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op1_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    s = secret_scan.scan(read(spark, d, "documents"))
    n_random = F.size("spans").cast("bigint") - F.size("base")
    return s.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secret_scan.joined(F.col("base")), 256).alias("base_sha256"), secret_scan.joined(F.col("spans")).alias("spans"), n_random.alias("n_random"))


def op2_chat_format(spark: SparkSession, d: str) -> DataFrame:
    bound_batches(spark)
    turns = read(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(EXTRA_TURNS, "conv_id bigint, turn bigint, role string, text string")
    return chat_format.digests(chat_format.format_conversations(turns.unionByName(extra)))


def op3_sharding(spark: SparkSession, d: str) -> DataFrame:
    s = sharding.assign(read(spark, d, "documents"), cut=1.0)  # the law of bytes holds even where one text fills more than a shard
    return s.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")


def tokenizer() -> tuple[bytes, str]:
    """The public rank file and its pattern; the path is a parameter of the operator, the file isn't part of this repository."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def op4_bpe_transducer(spark: SparkSession, d: str) -> DataFrame:
    bound_batches(spark)
    ranks, pattern = tokenizer()
    return bpe_transducer.round_trip(read(spark, d, "documents").select("doc_id", "text"), ranks, pattern).select("doc_id", "bpe.*")


def op5_jaccard_join(spark: SparkSession, d: str) -> DataFrame:
    bound_batches(spark)
    return jaccard_join.join(read(spark, d, "documents"), n=4, percent=85)


def op6_url_filter(spark: SparkSession, d: str) -> DataFrame:
    bound_batches(spark)
    return url_filter.judge(read(spark, d, "pages").select("page_id", "url"), RULES).select("page_id", "judged.*")


def classified(docs: DataFrame, mod: int, rest: int) -> DataFrame:
    return docs.select("doc_id", held_out(F.col("doc_id"), mod, rest).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_toxicity(spark: SparkSession, d: str) -> DataFrame:
    bound_batches(spark)
    docs = read(spark, d, "documents").select("doc_id", "text")
    labels = read(spark, d, "labels").where(~held_out(F.col("doc_id"), 5, 0))
    return classified(toxicity.score(docs, toxicity.fit(docs, labels)), 5, 0)


def op8_decontaminate(spark: SparkSession, d: str) -> DataFrame:
    r = decontaminate.decontaminate(read(spark, d, "documents").select("doc_id", "text"), read(spark, d, "benchmark"))
    return r.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "n_near")


def op9_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    bound_batches(spark)
    return quality_rules.judge(read(spark, d, "documents"))


def op10_zstd_quality(spark: SparkSession, d: str) -> DataFrame:
    bound_batches(spark)
    docs = read(spark, d, "documents").select("doc_id", "text")
    labels = read(spark, d, "labels").where(~held_out(F.col("doc_id"), 3, 1))
    return classified(zstd_quality.score(docs, zstd_quality.fit(docs, labels)), 3, 1)


def secret_scan_base(spark: SparkSession, d: str) -> DataFrame:
    """What SQL can express of operator 1: the base columns."""
    return op1_secret_scan(spark, d).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def quality_rules_base(spark: SparkSession, d: str) -> DataFrame:
    """What SQL can express of operator 9: the base columns."""
    return op9_quality_rules(spark, d).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_chat_format, op3_sharding, op4_bpe_transducer, op5_jaccard_join, op6_url_filter, op7_toxicity, op8_decontaminate, op9_quality_rules, op10_zstd_quality, secret_scan_base, quality_rules_base)}

UPPER, DOWN = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FITS = [f"(host = '{h}' or host like '%.{h}') and starts_with(path, '{p}')" for _, h, p in RULES]
_LONGEST = sorted(range(len(RULES)), key=lambda k: (-len(RULES[k][1].split(".")), -len(RULES[k][2])))

LOW = f"translate(coalesce(text, ''), '{UPPER}', '{DOWN}')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def decontaminate_words(column: str) -> str:
    """The words of operator 8."""
    return rf"regexp_extract_all(translate(coalesce({column}, ''), '{UPPER}', '{DOWN}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _spans(kind: str, k: int, pattern: str, group: int, least: int) -> str:
    """Leftmost matches of a pattern with their places: the lengths of the gaps and of the matches, added up."""
    return rf"""m{k} as (select row, doc_id, t, regexp_extract_all(t, '{pattern}') as hits, regexp_extract_all(t, '{pattern}', {group}) as vals, regexp_split_to_array(t, '{pattern}') as gaps from docs),
    e{k} as (select row, unnest(range(1, len(hits) + 1)) as i, hits, vals, gaps from m{k} where len(hits) > 0),
    s{k} as (select row, {k} as k, '{kind}' as kind, cast(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) as bigint) as a,
      length(hits[i]) as n from e{k} where length(vals[i]) >= {least})"""


_PATTERNS = [("assign", r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 1, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)]

#: Escaped text and role of operator 2's template.
_TEXT, _ROLE = r"replace(replace(x, '\', '\\'), '<|', '\<|')", r"replace(replace(replace(r, '\', '\\'), '<|', '\<|'), chr(10), '\' || chr(10))"

ORACLES = {
    "secret_scan_base": f"""with docs as (select row_number() over () as row, doc_id, coalesce(text, '') as t from documents),
    {", ".join(_spans(kind, k, p, g, n) for k, (kind, p, g, n) in enumerate(_PATTERNS))},
    s as (select * from s0 union all select * from s1 union all select * from s2),
    g as (select row, count(*) filter (where k = 0) as n0, count(*) filter (where k = 1) as n1, count(*) filter (where k = 2) as n2, string_agg(kind || ':' || a || ':' || (a + n), ',' order by a, k) as j from s group by row)
    select doc_id, coalesce(n0, 0) as n_assign, coalesce(n1, 0) as n_access, coalesce(n2, 0) as n_hex, sha256(coalesce(j, '')) as base_sha256 from docs left join g using (row)""",
    "op2_chat_format": f"""with t as (select conv_id, turn, coalesce(role, '') as r, coalesce(text, '') as x, text, role from conversations
      union all select * from (values (-7, 0, 'user', '\\### Assistant: </turn> ok', '', 'user'), (-7, 1, 'assistant', '\\### Assistant: </turn> ok', '', 'assistant')) as v(conv_id, turn, r, x, text, role))
    select conv_id, count(*) as n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' order by turn nulls first, role nulls first, x)) as turns_sha256,
      cast(coalesce(sum(length(x)) filter (where r = 'assistant'), 0) as bigint) as loss_chars,
      sha256(coalesce(string_agg(x, '' order by turn nulls first, role nulls first, x) filter (where r = 'assistant'), '')) as loss_sha256,
      cast(sum(length({_ROLE}) + length({_TEXT}) + {len(chat_format.TURN) + 1 + len(chat_format.END)}) as bigint) as formatted_chars, count(*) filter (where r = 'assistant') as n_loss_spans
    from t group by conv_id""",
    "op5_jaccard_join": f"""with recursive d as (select row_number() over () as row, doc_id, {_WORDS.format(LOW)} as w from documents),
    sh as (select distinct row, array_to_string(w[k:k + 3], ' ') as s from (select row, w, unnest(range(1, greatest(len(w) - 2, 2))) as k from d where len(w) > 0)),
    n as (select row, count(*) as n from sh group by row),
    fp as (select row, sha256(string_agg(s, chr(10) order by s)) as f from sh group by row),
    rep as (select f, min(row) as rep from fp group by f), same as (select row, rep from fp join rep using (f)),
    rs as (select rep as row, s from same join sh on sh.row = same.rep where same.row = same.rep),
    pairs as (select a.row as x, b.row as y, count(*) as i from rs a join rs b on a.s = b.s and a.row < b.row group by 1, 2),
    links as (select x, y from pairs join n nx on nx.row = x join n ny on ny.row = y where 100 * i >= 85 * (nx.n + ny.n - i)),
    two as (select x, y from links union all select y, x from links),
    reach(a, b) as (select row, row from same where row = rep union select reach.a, two.y from reach join two on two.x = reach.b),
    comp as (select a, min(b) as c from reach group by a),
    named as (select d.row, d.doc_id, coalesce(n.n, 0) as n, coalesce(comp.c, -d.row) as c from d left join n on n.row = d.row left join same on same.row = d.row left join comp on comp.a = same.rep)
    select doc_id, n as n_shingles, coalesce(min(doc_id) over (partition by c), doc_id) as component_id from named""",
    "op8_decontaminate": f"""with b as (select row_number() over () as item, cast(item_id as varchar) as item_id, {decontaminate_words("text")} as w from benchmark),
    it as (select * from b where len(w) > 0), d as (select row_number() over () as row, doc_id, {decontaminate_words("text")} as w from documents),
    win as (select distinct item_id, least(len(w), {decontaminate.WINDOW}) as k, array_to_string(w[p:p + least(len(w), {decontaminate.WINDOW}) - 1], ' ') as t
      from (select item_id, w, unnest(range(1, greatest(len(w) - {decontaminate.WINDOW - 1}, 1) + 1)) as p from it)),
    ats as (select row, w, unnest(range(1, len(w) + 1)) as p from d), sizes as (select distinct k from win),
    hit as (select a.row, a.p, win.k, win.item_id from ats a join sizes on a.p + sizes.k - 1 <= len(a.w) join win on win.k = sizes.k and win.t = array_to_string(a.w[a.p:a.p + sizes.k - 1], ' ')),
    covered as (select row, count(distinct q) as n_hit from (select row, unnest(range(p, p + k)) as q from (select distinct row, p, k from hit)) group by row),
    ids as (select row, count(*) as n_items, string_agg(item_id, ',' order by item_id) as j from (select distinct row, item_id from hit) group by row),
    iw as (select item, least(len(w), {decontaminate.SPAN}) as span, unnest(range(0, len(w))) as q, unnest(w) as t from it),
    dw as (select row, p - 1 as p, w[p] as t from ats),
    m as (select dw.row, iw.item, iw.span, cast(ceil(iw.span * {decontaminate.NEAR_PERCENT} / 100.0) as integer) as need, iw.q, dw.p - iw.q as dd from dw join iw using (t)),
    m2 as (select m.* from m join (select row, item from m group by row, item, need having count(distinct q) >= need) using (row, item)),
    bands as (select row, item, low, span, need, list_sort(list(distinct q)) as qs from (select row, item, span, need, q, unnest(range(dd - {decontaminate.SLOP - 1}, dd + 1)) as low from m2) group by all),
    near as (select row, count(distinct item) as n_near from bands where len(qs) >= need and len(list_filter(range(1, len(qs) - need + 2), lambda k: qs[k + need - 1] - qs[k] < span)) > 0 group by row)
    select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(j, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, coalesce(n_near, 0) as n_near
    from d left join covered using (row) left join ids using (row) left join near using (row)""",
    "quality_rules_base": rf"""with d as (select row_number() over () as row, doc_id, coalesce(text, '') as t, {_WORDS.format("coalesce(text, '')")} as w from documents),
    tri as (select row, p, array_to_string(w[p:p + 2], ' ') as s from (select row, w, unnest(range(1, len(w) - 1)) as p from d where len(w) >= 3)),
    twice as (select row, p from (select row, p, count(*) over (partition by row, s) as n from tri) where n > 1),
    rep as (select row, count(distinct q) as n from (select row, unnest([p, p + 1, p + 2]) as q from twice) group by row),
    ln as (select row, count(*) - count(distinct x) as n from (select row, unnest(string_split(t, chr(10))) as x from d) where regexp_matches(x, '[^ 	-
]') group by row),
    o as (select doc_id, len(w) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) as n_symbols,
      coalesce(ln.n, 0) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words from d left join rep using (row) left join ln using (row))
    select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from o""",
    "op6_url_filter": f"""with s as (select page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{UPPER}', '{DOWN}'), '') as host,
      coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path from pages),
    r as (select *, case {" ".join(f"when {_FITS[k]} then {k}" for k in _LONGEST)} end as k from s)
    select page_id, host, path, case k {" ".join(f"when {k} then '{h}{p}'" for k, (_, h, p) in enumerate(RULES))} end as rule,
      case k {" ".join(f"when {k} then '{v}'" for k, (v, _, _) in enumerate(RULES))} else 'allow' end as verdict from r""",
}
