"""The corpus operators' queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tactus.llm.bpe import encode_documents
from tactus.llm.chat_format import repair_chats
from tactus.llm.common import table
from tactus.llm.decontaminate import decontaminate
from tactus.llm.filter_audit import audit, failures
from tactus.llm.jaccard_join import jaccard_join
from tactus.llm.language_id import fit_languages, identify
from tactus.llm.prefix_trie import prefix_trie
from tactus.llm.quality_crf import classify, fit_quality
from tactus.llm.quality_rules import apply_rules, fit_rules
from tactus.llm.sharding import shard_documents
from tactus.llm.substring_dedup import remove_repeats
from tactus.llm.url_filter import judge_urls
from tactus.llm.warc import warc_round_trip


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_chats(table(spark, sf_dir, "conversations"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """The vocabulary file that the queries use; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_path(), room=3)  # nothing stands beside it: larger tables, less CPU time


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "sound")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"), keep=["text"]).drop("text")
    return out.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit_languages(docs))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_rules(docs, table(spark, sf_dir, "labels"))
    return apply_rules(docs, model)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"), k=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))).drop("filter")


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations")).drop("path", "path2", "parent", "parent2")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_quality": op2_quality,
    "op3_decontamination": op3_decontamination,
    "op4_bpe": op4_bpe,
    "op5_warc": op5_warc,
    "op6_sharding": op6_sharding,
    "op7_url_filter": op7_url_filter,
    "op8_language_id": op8_language_id,
    "op9_quality_rules": op9_quality_rules,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_filter_audit": op11_filter_audit,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op10_jaccard_join": r"""
        with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t-\r]+') as w from documents),
        s as (select distinct doc_id, array_to_string(w[p : p + 2], ' ') as s from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 2)::bigint + 1)) as p from w where len(w) > 0)),
        n as (select doc_id, count(*) as n from s group by doc_id),
        c as (select a.doc_id as x, b.doc_id as y, count(*) as k from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
        e as (select x, y from c join n p on p.doc_id = x join n q on q.doc_id = y where 100 * k >= 90 * (p.n + q.n - k)),
        r(x, z) as (select x, y from e union select r.x, e.y from r join e on r.z = e.x),
        m as (select x, min(z) as z from r group by x)
        select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(w.doc_id, m.z) as component_id
        from w left join n using (doc_id) left join m on m.x = w.doc_id""",
    "op3_decontamination": r"""
        with t as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as x from documents),
        d as (select doc_id, regexp_extract_all(x, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from t),
        b as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
        i as (select item_id, len(w) as n, w, unnest(range(1, greatest(1, len(w) - 9)::bigint + 1)) as p from b where len(w) > 0),
        q as (select distinct item_id, least(n, 10) as k, array_to_string(w[p : p + 9], ' ') as s from i),
        k as (select distinct k from q),
        e as (select doc_id, w, unnest(range(1, len(w) + 1)) as p from d),
        g as (select e.doc_id, e.p, k.k, array_to_string(e.w[e.p : e.p + k.k - 1], ' ') as s from e cross join k where e.p + k.k - 1 <= len(e.w)),
        m as (select g.doc_id, g.p, g.k, q.item_id from g join q on g.k = q.k and g.s = q.s),
        h as (select doc_id, count(distinct x) as n_hit from (select doc_id, unnest(range(p, p + k)) as x from m) group by doc_id),
        n as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from m group by doc_id)
        select d.doc_id, len(d.w)::bigint as n_words, coalesce(h.n_hit, 0)::bigint as n_hit, coalesce(n.n_items, 0)::bigint as n_items, sha256(coalesce(n.ids, '')) as items_sha256, h.n_hit is not null as contaminated
        from d left join h using (doc_id) left join n using (doc_id)""",
    "op5_warc": """
        with p as (select page_id, coalesce(html, '') as html from pages),
        d as (select page_id, octet_length(encode(html)) as n, sha1(html) as h, max(page_id) over (partition by html) as first from p)
        select page_id, n as payload_bytes,
            array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                1 + ((('0x' || substr(h, (5 * (i // 4) + 1)::int, 5))::int >> (15 - 5 * (i % 4))::int) & 31), 1)), '') as payload_digest,
            case when page_id = first then 'response' else 'revisit' end as record_type,
            case when page_id <> first then first end as refers_to,
            true as sound
        from d""",
    "op7_url_filter": """
        with p as (select page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
            coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path from pages),
        r(verdict, rule, h, p) as (values ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'),
            ('allow', 'www.example.com/en/', 'www.example.com', '/en/'), ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')),
        m as (select p.page_id, arg_max(r.rule, length(r.rule)) as rule, arg_max(r.verdict, length(r.rule)) as verdict
            from p join r on (p.host = r.h or p.host like '%.' || r.h) and starts_with(p.path, r.p) group by p.page_id)
        select p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') as verdict from p left join m using (page_id)""",
    "op11_filter_audit": r"""
        with recursive t as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as x, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') as w from documents),
        f as (select doc_id, part, (len(w) < 50)::int + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::int + 4 * (100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 5 * length(x))::int
            + 8 * regexp_matches(x, '[#$%&*|]')::int + 16 * coalesce(doc_id > min(doc_id) over (partition by x), false)::int as m from t),
        l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
        c as (select part, m, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic from f left join l using (doc_id) group by part, m),
        b as (select unnest(range(5)) as i),
        o(s, used, k) as (select '', 0, 0 union all select s || chr(65 + i::int), used | (1 << i::int), k + 1 from o, b where k < 5 and used & (1 << i::int) = 0),
        z as (select s, k, (1 << (ascii(s[k]) - 65)) as bit, list_reduce(list_prepend(0, list_transform(range(1, k), lambda j: 1 << (ascii(s[j]) - 65))), lambda x, y: x | y) as before
            from (select s, unnest(range(1, 6)) as k from o where o.k = 5)),
        r as (select part, s as filter_order, k::int as step, bit,
            sum(case when m & (before | bit) = 0 then n else 0 end)::bigint as kept,
            sum(case when m & before = 0 and m & bit > 0 then n else 0 end)::bigint as removed,
            sum(case when m & before > 0 and m & bit > 0 then n else 0 end)::bigint as redundant,
            sum(case when m = bit then n else 0 end)::bigint as unique_fails,
            sum(case when m & before = 0 and m & bit > 0 then good else 0 end)::bigint as good_lost,
            sum(case when m & before = 0 and m & bit > 0 then toxic else 0 end)::bigint as toxic_lost
            from c, z group by all)
        select * exclude (bit), (sum(removed) over (partition by part, bit))::bigint as shapley from r""",
    "op12_substring_dedup": r"""
        with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') as w from documents),
        g as (select doc_id, p, array_to_string(w[p : p + 49], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 48)) as p from d where len(w) >= 50)),
        m as (select doc_id, p, min(doc_id) over (partition by s) as least from g),
        r as (select distinct doc_id, unnest(range(p, p + 50)) as k from m where least < doc_id),
        t as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as k from d),
        x as (select t.doc_id, string_agg(t.word, ' ' order by t.k) as kept, count(*) as n from t anti join r on r.doc_id = t.doc_id and r.k = t.k group by t.doc_id)
        select d.doc_id, len(d.w)::bigint as n_words, (len(d.w) - coalesce(x.n, 0))::bigint as n_removed, sha256(coalesce(x.kept, '')) as kept_sha256 from d left join x using (doc_id)""",
    "op13_prefix_trie": r"""
        with t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, role, text) as k, {'r': coalesce(role, ''), 'x': coalesce(text, '')} as v from conversations where conv_id is not null),
        s as (select conv_id, list(v order by k) as own from t group by conv_id),
        h as (select conv_id, own, list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(conv_id::varchar, ''), lambda c: [ascii(c)::bigint, 0, 0, 0, 0, 0, 0, 0]))),
            lambda a, b: xor(xor(a, b) >> 1, case when xor(a, b) & 1 = 1 then 3988292384 else 0 end)) as c from s),
        b as (select h.conv_id, h.own, (xor(c, 4294967295::bigint) % 6)::int as n, coalesce(s.own, []) as base from h left join s on s.conv_id = h.conv_id - h.conv_id % 100),
        q as (select conv_id, list_concat(base[1:n], own[n + 1:]) as seq from b),
        m as (select conv_id, len(seq) as total, d, seq[d] as last, sha256(seq[1:d]::varchar) as id, sha256(seq[1:d - 1]::varchar) as up from (select conv_id, seq, unnest(range(0, len(seq) + 1)) as d from q)),
        n as (select id, d, any_value(up) as up, min(conv_id) as conv_id, count(*) as n_convs, any_value(coalesce(length(last.x), 0)) as points,
            sha256(coalesce(string_agg(case when total = d then conv_id::varchar end, ',' order by conv_id), '')) as ends_sha256 from m group by id, d),
        c as (select up, d, count(*) as k from n where d > 0 group by up, d),
        a as (select distinct x.id as id, x.d as d, y.id as below from m x join m y on x.conv_id = y.conv_id and y.d >= x.d),
        z as (select a.id, a.d, count(*) filter (where c.k is null) as n_leaves, sum((n.n_convs - 1) * n.points) as saved from a join n on n.id = a.below left join c on c.up = n.id and c.d = n.d + 1 group by a.id, a.d)
        select n.d::bigint as depth, n.conv_id, p.conv_id as parent_conv_id, n.n_convs, coalesce(c.k, 0)::bigint as n_children, z.n_leaves, z.saved::bigint as saved_tokens, n.ends_sha256
        from n left join n p on n.d > 0 and p.id = n.up and p.d = n.d - 1 left join c on c.up = n.id and c.d = n.d + 1 join z on z.id = n.id and z.d = n.d""",
    "op6_sharding": r"""
        with d as (select doc_id, coalesce(text, '') as x from documents),
        k as (select doc_id, x, (octet_length(encode(x)) + 16)::bigint as size, (((('0x' || md5(x)[1:10])::bigint & 549755813887) << 24) + ('0x' || md5(coalesce(doc_id::varchar, ''))[1:6])::bigint) as k from d),
        r as (select doc_id, x, size, row_number() over (order by k, doc_id) as r, 2 * (sum(size) over (order by k, doc_id rows unbounded preceding)) - size as mid, sum(size) over () as total from k),
        s as (select doc_id, x, size, r, len(list_filter(range(1, 40), lambda j: mid > 2 * ((total * j + 39) // 40)))::int as shard from r),
        b as (select doc_id, list_transform(string_split(hex(encode(x)), ''), lambda c: (strpos('0123456789ABCDEF', c) - 1)::bigint) as h from s where x <> ''),
        n as (select doc_id, xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(range(1, (len(h) // 2 + 1)::bigint), lambda i: [h[2 * i], 0, 0, 0, h[2 * i - 1], 0, 0, 0]))),
            lambda a, c: xor(xor(a, c) >> 1, case when xor(a, c) & 1 = 1 then 3988292384 else 0 end)), 4294967295::bigint) as crc from b)
        select s.doc_id, s.size, coalesce(n.crc, 0) as text_crc32, 'bytes' as law, s.shard, (row_number() over (partition by s.shard order by s.r) - 1)::bigint as slot, null::int as grown_shard from s left join n using (doc_id)""",
}
