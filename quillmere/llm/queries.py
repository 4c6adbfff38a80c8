"""The registered queries of these operators, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillmere.llm.common import read_table


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmere.llm.minhash import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"), ngram=2, threshold=0.8)


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmere.llm.secrets import secrets

    return secrets(read_table(spark, sf_dir, "documents")).drop("text_key")


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmere.llm.suffixes import without_repeated_bytes

    return without_repeated_bytes(read_table(spark, sf_dir, "documents"), window=400, shorter=256)


def op5_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmere.llm.pii import pseudonyms

    return pseudonyms(read_table(spark, sf_dir, "documents"), key="quillmere")


def op3_order_preserving_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quillmere.llm.packing import packed

    return packed(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_recompression_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmere.llm.recompression import without_repeats

    return without_repeats(read_table(spark, sf_dir, "documents"), window=13, texts=False)


def op8_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmere.llm.common import shared_dir
    from quillmere.llm.warc import read_archives, write_archives

    base = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(read_table(spark, sf_dir, "pages"), base), base)


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmere.llm.decontaminate import contaminated

    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), span=10).drop("text_key")


def op9_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmere.llm.sharding import sharded

    return sharded(read_table(spark, sf_dir, "documents"), shards=16)


def op10_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmere.llm.quality import verdicts

    return verdicts(read_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmere.llm.phrases import collocations

    return collocations(read_table(spark, sf_dir, "documents"), least=10, top=2000)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmere.llm.tree import conversation_trie, spliced, turn_lists

    return conversation_trie(spliced(turn_lists(read_table(spark, sf_dir, "conversations"))))


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from quillmere.llm.chat import digests, formatted, read_back

    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("<|im_end|><|im_start|>assistant ok").alias("text"))
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return digests(read_back(formatted(rows)))


QUERIES = {f.__name__: f for f in (op1_minhash_near_dedup, op2_secret_scans, op3_order_preserving_packing, op4_suffix_array_dedup, op5_feistel_pseudonyms, op6_benchmark_decontamination, op7_recompression_substring_dedup, op8_warc_writer, op9_jump_sharding, op10_host_quality_rules, op11_phrase_collocations, op12_conversation_trie, op13_chat_formatting)}

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
WORDS6 = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

# A decimal number's CRC-32: fixed polynomial 0xEDB88320, one bit a step.
CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::bigint)), lambda s, b: list_reduce(list_prepend(xor(s, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"

SQL = {
    "op1_minhash_near_dedup": rf"""
with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
sets as (select doc_id, case when len(w) = 0 then [] when len(w) = 1 then w else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end as s from w),
classes as (select s, min(doc_id) as rep from sets where len(s) > 0 group by s),
ranked as (select g, row_number() over (order by count(*), g) as r from (select unnest(s) as g from classes) group by g),
placed as (select rep, len(s) as n, unnest(s) as g from classes),
ordered as (select p.rep, p.n, r.r, row_number() over (partition by p.rep order by r.r) as place from placed p join ranked r using (g)),
prefix as (select * from ordered where place <= n - (80 * n + 99) // 100 + 1),
pairs as (select distinct a.rep as a, b.rep as b from prefix a join prefix b on a.r = b.r and a.rep < b.rep and 100 * a.n >= 80 * b.n and 100 * b.n >= 80 * a.n),
joined as (select a, b, len(x.s) + len(y.s) as total, len(list_intersect(x.s, y.s)) as both_n from pairs join classes x on x.rep = a join classes y on y.rep = b),
links as (select a, b from joined where 100 * both_n >= 80 * (total - both_n)),
edges as (select a, b from links union select b, a from links),
reach(a, b) as (select rep, rep from classes union select reach.a, edges.b from reach join edges on edges.a = reach.b),
comp as (select a, min(b) as c from reach group by a)
select d.doc_id, len(d.s)::bigint as n_shingles, coalesce(comp.c, d.doc_id) as component_id, coalesce(comp.c, d.doc_id) = d.doc_id as kept
from sets d left join classes on classes.s = d.s and len(d.s) > 0 left join comp on comp.a = classes.rep""",
    "op6_benchmark_decontamination": rf"""
with d as (select doc_id, {WORDS6} as w from documents), i as (select item_id::varchar as item, {WORDS6} as w from benchmark),
iw as (select distinct item, least(10, len(w)) as m, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') as win from (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as k from i where len(w) > 0)),
ms as (select distinct m from iw),
dw as (select doc_id, k, m, array_to_string(w[k:k + m - 1], ' ') as win from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) as k from d, ms where len(w) >= m)),
hit as (select doc_id, k, iw.m, item from dw join iw using (win, m)),
covered as (select doc_id, count(distinct k + x) as n_hit from (select distinct doc_id, k, m, unnest(range(0, m)) as x from hit) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as s from (select distinct doc_id, item from hit) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered using (doc_id) left join its using (doc_id)""",
    "op7_recompression_substring_dedup": rf"""
with d as (select doc_id, {WORDS} as w from documents),
win as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from d where len(w) >= 13)),
f as (select g, min(doc_id) as first from win group by g),
gone as (select distinct doc_id, i + x as i from (select win.doc_id, i, unnest(range(0, 13)) as x from win join f using (g) where first < win.doc_id)),
words as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as i from d where len(w) > 0),
kept as (select doc_id, count(gone.i) as n_removed, coalesce(string_agg(x, ' ' order by i) filter (where gone.i is null), '') as t from words left join gone using (doc_id, i) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept using (doc_id)""",
    "op8_warc_writer": """
with p as (select page_id, coalesce(html, '') as h, strlen(coalesce(html, ''))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select payload_digest, min(page_id) as first from p where payload_bytes >= 100 group by payload_digest)
select page_id, payload_bytes, payload_digest, case when first < page_id then 'revisit' else 'response' end as record_type, case when first < page_id then first end as refers_to from p left join f using (payload_digest)""",
    "op10_host_quality_rules": rf"""
with d as (select doc_id, lower(source) as host, coalesce(text, '') as t, {WORDS} as w from documents),
l as (select doc_id, host, t, w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
tri as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d where len(w) > 2)),
rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from tri) where c > 1),
cov as (select doc_id, count(distinct i + x) as n from (select doc_id, i, unnest([0, 1, 2]) as x from rep) group by doc_id),
m as (select l.doc_id, host, len(w)::bigint as n_words, len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars, (len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
 len(l.l)::bigint as n_lines, (len(l.l) - len(list_distinct(l.l)))::bigint as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words from l left join cov using (doc_id)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, 10 * n_symbols > word_chars as sym, 100 * n_dup_lines > 30 * n_lines as dup from m),
h as (select host, rule, count(*) as n, count(*) filter (where bad) as fails from (select host, unnest([1, 2, 3]) as rule, unnest([base_failed, sym, dup]) as bad from f where host is not null) group by host, rule),
g as (select rule, sum(n) as n, count(*) as hosts, sum(fails) / sum(n) as mean, sum(fails * fails / n) as q from h group by rule),
p as (select *, mean * (1 - mean) as within, q / n - mean * mean - mean * (1 - mean) * hosts / n as between_h from g),
k as (select rule, mean, least(10000.0, greatest(10.0, case when between_h > 0 then within / between_h - 1 else 10000.0 end)) as strength from p),
bad as (select distinct host from h join k using (rule) where (fails + mean * strength) / (n + strength) > 0.5)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and bad.host is null as kept from f left join bad on bad.host = f.host""",
    "op11_phrase_collocations": r"""
with p as (select row_number() over () as id, lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as w from (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents)),
ats as (select lang, w, unnest(range(1, len(w) + 1)) as i from p where len(w) > 0),
f1 as (select lang, w[i] as x, count(*) as f from ats group by all),
f2 as (select lang, w[i] as x, w[i + 1] as y, count(*) as f from ats where i < len(w) group by all),
f3 as (select lang, w[i] as x, w[i + 1] as y, w[i + 2] as z, count(*) as f from ats where i + 1 < len(w) group by all having count(*) >= 10),
n as (select lang, sum(f)::bigint as n from f1 group by lang),
longer as (select lang, x, y, max(f) as f from (select lang, x, y, f from f3 union all select lang, y, z, f from f3) group by all),
two as (select f2.lang, f2.x || ' ' || f2.y as phrase, f2.f as a, u.f as l, v.f as r, 1 as k from f2 join f1 u on u.lang = f2.lang and u.x = f2.x join f1 v on v.lang = f2.lang and v.x = f2.y left join longer o on o.lang = f2.lang and o.x = f2.x and o.y = f2.y
 where f2.f >= 10 and coalesce(100 * o.f < 50 * f2.f, true)),
three as (select f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z as phrase, f3.f as a, u.f as l, v.f as r, 1 as k from f3 join f1 u on u.lang = f3.lang and u.x = f3.x join f2 v on v.lang = f3.lang and v.x = f3.y and v.y = f3.z
 union all select f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z, f3.f, u.f, v.f, 2 from f3 join f2 u on u.lang = f3.lang and u.x = f3.x and u.y = f3.y join f1 v on v.lang = f3.lang and v.x = f3.z),
cuts as (select *, (1000000::hugeint * a * a // (l::hugeint * r))::bigint as score from (select * from two union all select * from three)),
lowest as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
best as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from lowest)
select lang, rank, phrase, a, l, r, n, score from best join n using (lang) where rank <= 2000""",
    "op12_conversation_trie": f"""
with own as (select conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} order by turn nulls first) as t from conversations where conv_id is not null group by conv_id),
h as (select *, ({CRC} % 6)::bigint as h from own),
seq as (select h.conv_id, coalesce(b.t[1:h.h], []) || h.t[h.h + 1:] as t from h left join own b on b.conv_id = h.conv_id - h.conv_id % 100),
pre as (select conv_id, t[1:d] as p, d, d = len(t) as ends from (select conv_id, t, unnest(range(0, len(t) + 1)) as d from seq)),
nodes as (select p, d, min(conv_id) as conv_id, count(*) as n_convs, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ends), '')) as ends_sha256 from pre group by p, d),
kids as (select p[1:d - 1] as p, count(*) as n_children from nodes where d > 0 group by 1),
told as (select n.*, coalesce(k.n_children, 0) as n_children, case when d > 0 then (n_convs - 1) * length(n.p[d].text) else 0 end as saved from nodes n left join kids k using (p)),
below as (select p[1:e] as p, count(*) filter (where n_children = 0) as n_leaves, sum(saved)::bigint as saved_tokens from (select *, unnest(range(0, d + 1)) as e from told) group by 1)
select t.conv_id, t.d as depth, u.conv_id as parent_conv_id, t.n_convs, t.n_children, n_leaves, saved_tokens, t.ends_sha256 from told t join below using (p) left join nodes u on t.d > 0 and u.p = t.p[1:t.d - 1]""",
    "op13_chat_formatting": r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select -1, i, case i when 0 then 'user' else 'assistant' end, '<|im_end|><|im_start|>assistant ok' from range(2) r(i)),
t as (select *, length(replace(replace(text, '<\', '<\\'), '<|', '<\|')) + length(replace(replace(replace(role, '%', '%25'), '<', '%3C'), chr(10), '%0A')) + 24 as chars from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256, coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
 sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256, sum(chars)::bigint as formatted_chars from t group by conv_id""",
}
