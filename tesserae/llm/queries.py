"""Named queries over the given tables, one for each operator, each with its SQL counterpart where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import collocations, conversation_trie, decontaminate, exact_dedup, jaccard_join, lm_scoring, packing, page_diff, quality_classifier, repeats, substring_dedup, suffix_dedup, token_counts, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The closing id of a document.
CLOSING = 2


@query("op2_packing")
def op2(spark, sf_dir):
    """Every piece of every document with its place in a sequence."""
    cut = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), CLOSING)
    return packing.pack(cut.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"))


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op3_exact_dedup",
    f"""
    with d as (select doc_id, {_LOWERED} as t from documents)
    select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
           doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
    from d
    """,
)
def op3(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


#: Host, path and verdict of the url rules.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


@query(
    "op6_url_filter",
    r"""
    with r as (select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages),
    h as (select page_id, regexp_extract(coalesce(rest, ''), '^[^/?#]*') as host0, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path from r),
    p as (select page_id, translate(host0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from h),
    rules(rhost, rpath, verdict) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
    m as (select page_id, rhost || rpath as rule, rules.verdict, row_number() over (partition by page_id order by length(rhost || rpath) desc) as k
          from p join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath))
    select p.page_id, host, path, m.rule, coalesce(m.verdict, 'allow') as verdict from p left join m on p.page_id = m.page_id and k = 1
    """,
)
def op6(spark, sf_dir):
    rules = spark.createDataFrame([*RULES], "host string, path string, verdict string")
    return url_filter.url_filter(table(spark, sf_dir, "pages"), rules)


@query("op10_token_counts")
def op10(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query("op9_quality_classifier")
def op9(spark, sf_dir):
    """Probability of being good, by view and combined, and the decision, for every document."""
    return quality_classifier.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op1_decontaminate")
def op1(spark, sf_dir):
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op8_lm_scoring")
def op8(spark, sf_dir):
    return lm_scoring.lm_scores(table(spark, sf_dir, "documents"))


@query("op4_substring_dedup")
def op4(spark, sf_dir):
    members, results = substring_dedup.by_text(table(spark, sf_dir, "documents"))
    digests = results.select("key", "first", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"), F.sha2("full_text", 256).alias("full_sha256"))
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return repeats.answers(members, digests, substring_dedup.WINDOW, "n_words", {"n_removed": F.col("n_words"), "kept_sha256": nothing}, {"n_removed": F.lit(0).cast("long"), "kept_sha256": F.col("full_sha256")})


@query("op7_suffix_dedup")
def op7(spark, sf_dir):
    members, results = suffix_dedup.by_text(table(spark, sf_dir, "documents"))
    digests = results.select("key", "first", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.sha2("full", 256).alias("full_sha256"))
    zero, nothing = F.lit(0).cast("long"), F.sha2(F.lit("").cast("binary"), 256)
    whole = {"n_removed": F.col("n_bytes"), "n_spans": F.lit(1).cast("long"), "kept_sha256": nothing}
    return repeats.answers(members, digests, suffix_dedup.WINDOW, "n_bytes", whole, {"n_removed": zero, "n_spans": zero, "kept_sha256": F.col("full_sha256")})


@query("op5_jaccard_join")
def op5(spark, sf_dir):
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents"), words=3, percent=90)


@query(
    "op11_conversation_trie",
    """
    with recursive own as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
                        row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as at
                 from conversations where conv_id is not null),
    convs as (select conv_id, conv_id - conv_id % 5 as base, count(*) as n from own group by all),
    bits as (select conv_id, base, n, cast(conv_id as varchar) as name from convs),
    steps as (select conv_id, 0 as k, cast(4294967295 as ubigint) as crc from bits
              union all
              select s.conv_id, k + 1, case when (x & 1) = 1 then xor(x >> 1, cast(3988292384 as ubigint)) else x >> 1 end
              from (select s.conv_id, s.k, case when s.k % 8 = 0 then xor(s.crc, cast(ascii(substr(b.name, s.k // 8 + 1, 1)) as ubigint)) else s.crc end as x
                    from steps s join bits b using (conv_id) where s.k < 8 * length(b.name)) s),
    plan as (select b.conv_id, b.base, b.n, xor(max_by(s.crc, s.k), cast(4294967295 as ubigint)) % 9 as h from bits b join steps s using (conv_id) group by all),
    plans as (select p.*, least(h, coalesce(c.n, 0)) as m from plan p left join convs c on c.conv_id = p.base),
    rebuilt as (select p.conv_id, o.at + 1 as depth, role, text from plans p join own o on o.conv_id = p.base and o.at < p.h
                union all
                select p.conv_id, o.at - p.h + p.m + 1, role, text from plans p join own o on o.conv_id = p.conv_id and o.at >= p.h),
    path as (select conv_id, depth, octet_length(encode(text)) as bytes,
                    list(sha256(role || chr(1) || text)) over (partition by conv_id order by depth) as turns from rebuilt),
    member as (select conv_id, depth, bytes, sha256(array_to_string(turns, ',')) as key, lag(sha256(array_to_string(turns, ','))) over (partition by conv_id order by depth) as parent from path
               union all select conv_id, 0, 0, 'root', null from convs),
    linked as (select conv_id, depth, bytes, key, case when depth = 1 then 'root' else parent end as parent,
                      depth = max(depth) over (partition by conv_id) as is_end from member),
    node as (select key, any_value(parent) as parent, any_value(depth) as depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(bytes) as bytes,
                    string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (is_end) as ends from linked group by key),
    kids as (select n.*, (select count(*) from node c where c.parent = n.key) as n_children from node n),
    rolled as (select m.key, count(*) filter (k.n_children = 0) as n_leaves, sum((k.n_convs - 1) * k.bytes) as saved
               from kids k join linked m on m.conv_id = k.conv_id and m.depth <= k.depth group by m.key)
    select k.conv_id, cast(k.depth as bigint) as depth, p.conv_id as parent_conv_id, k.n_convs, k.n_children, r.n_leaves, cast(r.saved as bigint) as saved_tokens, sha256(coalesce(k.ends, '')) as ends_sha256
    from kids k join rolled r using (key) left join node p on p.key = k.parent
    """,
)
def op11(spark, sf_dir):
    return conversation_trie.prefix_trie(table(spark, sf_dir, "conversations")).drop("key")


@query(
    "op12_collocations",
    rf"""
    with piece as (select coalesce(lang, 'und') as lang, unnest(string_split_regex({_LOWERED}, '[.,;:!?
-
]')) as p from documents),
    run as (select lang, list_filter(string_split_regex(p, '[ 	]+'), lambda x: x <> '') as w from piece),
    word as (select lang, w, unnest(range(1, len(w) + 1)) as i from run),
    gram as (select lang, w[i] as w1, w[i + 1] as w2, w[i + 2] as w3 from word),
    f1 as (select lang, w1, count(*) as a from gram group by all),
    f2 as (select lang, w1, w2, count(*) as a from gram where w2 is not null group by all having count(*) >= 10),
    f3 as (select lang, w1, w2, w3, count(*) as a from gram where w3 is not null group by all having count(*) >= 10),
    cut as (select lang, w1 || ' ' || w2 as phrase, f2.a, 1 as i, x.a as l, y.a as r from f2 join f1 x using (lang, w1) join (select lang, w1 as w2, a from f1) y using (lang, w2)
            where not exists (select 1 from f3 t where t.lang = f2.lang and (t.w1 = f2.w1 and t.w2 = f2.w2 or t.w2 = f2.w1 and t.w3 = f2.w2) and 100 * t.a >= 50 * f2.a)
            union all select lang, w1 || ' ' || w2 || ' ' || w3, f3.a, 1, x.a, y.a from f3 join f1 x using (lang, w1) join (select lang, w1 as w2, w2 as w3, a from f2) y using (lang, w2, w3)
            union all select lang, w1 || ' ' || w2 || ' ' || w3, f3.a, 2, x.a, y.a from f3 join f2 x using (lang, w1, w2) join (select lang, w1 as w3, a from f1) y using (lang, w3)),
    scored as (select *, 1000000 * a::hugeint * a // (l::hugeint * r) as score from cut),
    lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, i) = 1),
    ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from lowest),
    total as (select lang, sum(a) as n from f1 group by lang)
    select lang, rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score from ranked join total using (lang) where rank <= 2000
    """,
)
def op12(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query("op13_html_extraction")
def op13(spark, sf_dir):
    return page_diff.main_text(table(spark, sf_dir, "pages"))
