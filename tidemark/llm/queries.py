"""The operators as queries over the tables they are meant for, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat, decontaminate, fim, licenses, linededup, packing, phrases, pii, quality, sharding, simhash, substring, urlfilter

RULES = [urlfilter.Rule("block", "com", "/en/"), urlfilter.Rule("allow", "example.com", "/en/7"), urlfilter.Rule("allow", "net", "/de/"), urlfilter.Rule("block", "example.net", "/de/8"), urlfilter.Rule("block", "org", "/es/")]


#: Rows of a smaller file are dealt out to all cores, as a file of one row group is one task's work whatever the cores.
SPREAD_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out to all cores if it is small and has fewer partitions than there are cores; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) > SPREAD_BYTES or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "n_shared", "n_item")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.repeated_lines(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_lines", F.size("dropped").cast("long").alias("n_dropped"), F.concat_ws(",", F.col("dropped").cast("array<string>")).alias("dropped"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(_table(spark, sf_dir, "documents"), tokenizer_path())


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summary(_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_clean_words")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files of a tree: source, language, and a folder for each 64 consecutive ids."""
    docs = _table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.col("source"), F.col("lang"), F.floor(F.col("doc_id") / 64).cast("string"), F.col("doc_id").cast("string"))
    return licenses.scan(docs.select("doc_id", "text", path.alias("path")))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat.render(_table(spark, sf_dir, "conversations"))
    return found.select("conv_id", "n_turns", F.sha2("rendered", 256).alias("rendered_sha256"), F.length("rendered").cast("long").alias("n_chars"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(_table(spark, sf_dir, "documents"), 24)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_decontaminate, op3_line_dedup, op4_substring_dedup, op5_best_fit_packing, op6_pii, op7_quality, op8_url_filter, op9_license_scan, op10_chat_format, op11_phrases, op12_sharding, op13_fill_in_middle, pipeline)}


_WORD = r"[^\x20\x09-\x0D]+"

_OP2 = f"""
with d as (select distinct doc_id, text, regexp_extract_all(lower(text), '{_WORD}') w from documents where text is not null),
b as (select distinct item_id, text, regexp_extract_all(lower(text), '{_WORD}') w from benchmark where text is not null),
ds as (select distinct doc_id, text, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) s from d),
bs as (select distinct item_id, text t, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) s from b),
n as (select item_id, t, count(*) n_item from bs group by all),
c as (select doc_id, text, item_id, t, count(*) n_shared from ds join bs using (s) group by all)
select c.doc_id, c.item_id, c.n_shared, n.n_item from c join n on n.item_id is not distinct from c.item_id and n.t = c.t
where c.n_shared >= n.n_item * 0.8 - 1e-9
"""

_OP4 = f"""
with d as (select row_number() over () r, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') w from documents),
g as (select r, i, md5(array_to_string(w[i:i+34], ' ')) s from (select r, w, unnest(range(1, len(w) - 33)) i from d where len(w) >= 35)),
h as (select r, i from g qualify count(*) over (partition by s) > 1),
u as (select distinct r, p from (select r, unnest(range(i, i + 35)) p from h)),
x as (select r, unnest(w) x, unnest(range(1, len(w) + 1)) p from d),
k as (select r, string_agg(x, ' ' order by p) t from x where not exists (select 1 from u where u.r = x.r and u.p = x.p) group by r),
n as (select r, count(*)::bigint n from u group by r)
select doc_id, len(w)::bigint n_words, coalesce(n, 0)::bigint n_removed, sha256(coalesce(t, '')) kept_sha256 from d left join n using (r) left join k using (r)
"""

_FAILS = f"""(len(regexp_replace(l, '[^#*$%&|<>]+', '', 'g')) * 10 > len(l)
 or (len(regexp_extract_all(l, '{_WORD}')) >= 4 and len(regexp_extract_all(regexp_replace(l, '[\\x20\\x09-\\x0D]', '  ', 'g') || '  ', '[!?]{{2,}}[ ]')) * 2 > len(regexp_extract_all(l, '{_WORD}')))
 or (len(regexp_replace(l, '[^|]+', '', 'g')) >= 2 and len(regexp_extract_all(l, '{_WORD}')) - len(regexp_replace(l, '[^|]+', '', 'g')) <= 4 * (len(regexp_replace(l, '[^|]+', '', 'g')) + 1))
 or regexp_matches(l, '{quality.BOILERPLATE}'))"""

_OP7 = f"""
with d as (select row_number() over () r, doc_id, coalesce(text, '') text from documents),
w as (select *, regexp_extract_all(text, '{_WORD}') w, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{_WORD}')) lines from d),
g as (select r, i, array_to_string(w[i:i+4], ' ') s from (select r, w, unnest(range(1, len(w) - 3)) i from w where len(w) >= 5)),
x as (select r, i from g qualify count(*) over (partition by r, s) > 1),
y as (select r, sum(least(5, coalesce(nxt - i, 5)))::bigint n from (select r, i, lead(i) over (partition by r order by i) nxt from x) group by r),
c as (select r, sum(len(regexp_extract_all(l, '{_WORD}')))::bigint n from (select r, unnest(lines) l from w) where not {_FAILS} group by r),
a as (select doc_id, len(w)::bigint n_words, len(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::bigint word_chars,
 len(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint n_symbols, (len(lines) - len(list_distinct(lines)))::bigint n_dup_lines,
 coalesce(y.n, 0)::bigint n_repeat_words, coalesce(c.n, 0)::bigint n_clean_words
 from w left join y using (r) left join c using (r)),
f as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed from a)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 not base_failed and n_clean_words >= n_words * {quality.KEEP_SHARE} kept, n_clean_words from f
"""

_TERMS = r"list_filter(list_transform(string_split(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}.-]+', ' ', 'g'), ' '), lambda w: trim(w, '.-')), lambda w: w <> '')"
_KINDS = ", ".join("({}, '{}', '{}')".format(i, n, t.replace("'", "''")) for i, (n, t) in enumerate(licenses.TEMPLATES))
_OP9 = rf"""
with f as (select row_number() over () r, doc_id id, concat_ws('/', source, lang, cast(floor(doc_id / 64) as bigint)::varchar, doc_id::varchar) path, coalesce(text, '') t from documents),
m as (select r, string_split_regex(regexp_replace(t, '([.;!?])[\x20\t]+', '\1' || chr(10), 'g'), '\r?\n') l from f where regexp_matches(t, '{licenses.MARKER}')),
hit as (select r, len(l) size, unnest(list_filter(range(0, len(l)), lambda i: regexp_matches(l[i + 1], '{licenses.MARKER}'))) a from m),
reg as (select r, size, min(a) f, max(a) e from (select *, sum(h) over (partition by r order by a) g from (select *, case when a - lag(a) over (partition by r order by a) <= {licenses.GAP} then 0 else 1 end h from hit)) group by r, size, g),
win as (select r, size, a s, 1 n from hit union all select r, size, a, 2 from hit union all select r, size, a - 1, 2 from hit
 union all select r, size, unnest(range(f - 2, case when e - f < {licenses.REGION} then e else f + {licenses.HEAD} - 1 end + 1)) s, n from reg, (select unnest({list(licenses.SPANS)}) n)
 union all select r, size, unnest(range(f, e + 1, greatest(n // 4, 1))) s, n from reg, (select unnest({list(licenses.STRIDED)}) n) where e - f >= {licenses.REGION}),
cut as (select distinct r, greatest(s, 0) s, least(n, size - greatest(s, 0)) n from win where greatest(s, 0) < size),
blk as (select * from (select r, s, n, array_to_string(l[s + 1:s + n], ' ') block from cut join m using (r)) where n = 1 or len(list_distinct(regexp_extract_all(block, '{_WORD}'))) <= {licenses.MAX_WORDS}),
u as (select distinct block from blk),
kinds as (select * from (values {_KINDS}) k(template, license, block)),
bag as (select block, term, count(*) tf from (select block, unnest({_TERMS.format("block")}) term from u) group by all),
known as (select template, license, term, count(*) tf from (select template, license, unnest({_TERMS.format("block")}) term from kinds) group by all),
idf as (select term, ln((select count(*) + {len(licenses.TEMPLATES)} + 1 from u)::double / (count(*) + 1)) + 1 idf from (select term from bag union all select term from known) group by term),
b as (select block, term, tf * idf w from bag join idf using (term)),
v as (select template, license, term, tf * idf v from known join idf using (term)),
n as (select b.block, v.template, any_value(v.license) license, sum(w * v) / (any_value(s.size) * any_value(h.len)) c from b join v using (term) join (select template, sqrt(sum(v * v)) size from v group by 1) s on s.template = v.template join (select block, sqrt(sum(w * w)) len from b group by 1) h on h.block = b.block group by 1, 2),
spdx as (select block, regexp_replace(regexp_extract(block, '{licenses.SPDX_EXPRESSION}', 1), '[\x20\t]+', ' ', 'g') license from u),
scored as (select block, license, c from (select block, license, c from n where c >= {licenses.MIN_COSINE} union all select block, license, 1.0::double from spdx where license <> '') qualify row_number() over (partition by block order by round(c, 9) desc, license) = 1),
hits as (select blk.*, license, c from blk join scored using (block)),
cover as (select r, sum(len(regexp_extract_all(l[p + 1], '{_WORD}'))) words from (select distinct r, unnest(range(s, s + n)) p from hits) join m using (r) group by r),
own as (select r, license, c, words from hits join cover using (r) qualify row_number() over (partition by r order by round(c, 9) desc, license) = 1),
j as (select f.r, id, path, array_to_string(list_slice(string_split(path, '/'), 1, len(string_split(path, '/')) - 1), '/') dir, license, c,
 words is not null and (len(regexp_extract_all(t, '{_WORD}')) - words <= 20 or regexp_matches(string_split(path, '/')[-1], '{licenses.FILE_NAMES}')) is_file from f left join own using (r)),
src as (select dir above, license, id from j where is_file qualify row_number() over (partition by dir order by round(c, 9) desc, id) = 1),
up as (select dir, k, array_to_string(list_slice(string_split(dir, '/'), 1, k), '/') above from (select dir, unnest(range(0, len(string_split(dir, '/')) + 1)) k from (select distinct dir from j))),
near as (select dir, license, id from up join src using (above) qualify row_number() over (partition by dir order by k desc) = 1)
select j.id doc_id, path, coalesce(j.license, near.license) license, round(c, 6) cosine, case when j.license is not null then 'own' when near.license is not null then 'inherited' else 'none' end how,
 case when j.license is not null then j.id else near.id end from_id from j left join near using (dir)
"""

_OP10 = """
with t as (select distinct conv_id, turn, role, text from conversations where conv_id is not null),
c as (select conv_id, list({'r': role, 't': text} order by turn nulls first, role nulls first, text nulls first) x from t group by conv_id),
u as (select min(conv_id) conv_id, x from c group by x),
k as (select conv_id, x from u a where not exists (select 1 from u b where b.x[1] is not distinct from a.x[1] and len(b.x) > len(a.x) and b.x[1:len(a.x)] = a.x)),
r as (select conv_id, len(x)::bigint n_turns, array_to_string(list_transform(x, lambda e: '<|' || coalesce(e.r, 'unknown') || '|>' || chr(10) || coalesce(e.t, '')), chr(10)) s from k)
select conv_id, n_turns, sha256(s) rendered_sha256, len(s)::bigint n_chars from r
"""

_LONGER = "(select lang, p, a, w, unnest(range(1, len(w))) i from c where len(w) > 2)"
_OP11 = f"""
with d as (select coalesce(lang, 'und') lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
s as (select lang, regexp_extract_all(unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') w from d),
g as (select lang, m, array_to_string(w[i:i+m-1], ' ') p from (select lang, w, m, unnest(range(1, len(w) - m + 2)) i from (select lang, w, unnest([1, 2, 3]) m from s) where len(w) >= m)),
f as (select lang, m, p, count(*)::bigint f from g group by all),
n as (select lang, sum(f)::bigint n from f where m = 1 group by lang),
c as (select lang, p, f a, string_split(p, ' ') w from f where m >= 2 and f >= 10),
k as (select lang, p, a, k, array_to_string(w[1:k], ' ') x, array_to_string(w[k+1:], ' ') y from (select *, unnest(range(1, len(w))) k from c)),
v as (select k.lang, k.p, a, k, x.f l, y.f r, ((1000000::hugeint * a * a) // (x.f::hugeint * y.f))::bigint score from k join f x on x.lang = k.lang and x.p = k.x join f y on y.lang = k.lang and y.p = k.y),
b as (select * from v qualify row_number() over (partition by lang, p order by score, k) = 1),
h as (select lang, array_to_string(w[i:i+1], ' ') p, max(a) held from {_LONGER} group by 1, 2),
o as (select b.*, row_number() over (partition by b.lang order by score desc, a desc, b.p) rank from b left join h on h.lang = b.lang and h.p = b.p where held is null or 100 * held < 50 * a)
select lang, rank, p phrase, a, l, r, n, score from o join n using (lang) where rank <= 2000
"""

_CRC_TABLE = "(select list(t order by i) from (select i, list_reduce([i::bigint, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) t from range(256) x(i)))"
_CRC = f"(select xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: ('0x' || x)::bigint)), lambda c, b: xor(c >> 8, crc[1 + (xor(c, b) & 255)])), 4294967295))"
_OP12 = f"""
with recursive d as (select row_number() over () row, doc_id, coalesce(text, '') t, ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 16))::ubigint::hugeint key from documents),
j as (select row, key k, -1::bigint b, 0::bigint j from d union all
 select row, k, j, floor((j + 1) * (2147483648.0::double / ((k // 8589934592)::double + 1)))::bigint from (select row, (k * 2862933555777941757 + 1) % 18446744073709551616 k, j from j where j < 25)),
s as (select row, max(b) filter (b < 24) shard, max(b) filter (b < 25) grown from j group by row),
x as (select doc_id, (strlen(t) + 8)::bigint size, {_CRC.replace("(select ", "", 1)[:-1]}::bigint text_crc32, shard::int shard, grown::int grown_shard from d join s using (row), (select {_CRC_TABLE} crc))
select doc_id, size, text_crc32, 'key' law, shard, (row_number() over (partition by shard order by doc_id nulls first, text_crc32, size) - 1)::bigint slot, grown_shard from x
"""

_OP13 = """
with d as (select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') w, sha256('42:' || coalesce(doc_id::varchar, '')) h from documents),
s as (select doc_id, t, w, len(w)::bigint n, [('0x' || substr(h, 1, 8))::bigint, ('0x' || substr(h, 9, 8))::bigint, ('0x' || substr(h, 17, 8))::bigint, ('0x' || substr(h, 25, 8))::bigint] h from d),
c as (select *, least(h[1] % (n + 1), h[2] % (n + 1)) a, greatest(h[1] % (n + 1), h[2] % (n + 1)) b, case when t = '' or regexp_matches(t, '<[PSM]>') or h[3] % 100 >= 50 then 'plain' when h[4] % 100 < 80 then 'spm' else 'psm' end form from s),
p as (select doc_id, t, n, form, array_to_string(w[1:a], '') p, array_to_string(w[a+1:b], '') m, array_to_string(w[b+1:], '') s from c)
select doc_id, n, form, case when form <> 'plain' then length(p)::bigint end prefix_chars, case when form <> 'plain' then length(m)::bigint end middle_chars,
 sha256(case form when 'plain' then t when 'psm' then concat('<P>', p, '<S>', s, '<M>', m) else concat('<S>', s, '<P>', p, '<M>', m) end) output_sha256, sha256(t) restored_sha256 from p
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": _OP2, "op4_substring_dedup": _OP4, "op7_quality": _OP7, "op9_license_scan": _OP9, "op10_chat_format": _OP10, "op11_phrases": _OP11, "op12_sharding": _OP12, "op13_fill_in_middle": _OP13}
