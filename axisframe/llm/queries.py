"""Queries of this subpackage's operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chaining, linerules, mixing, packing, ppm, suffix, superminhash, topk, toxicity, warc
from .shared import table


#: Target weights of some sources; every other source has weight 1.
MIX_WEIGHTS = {"src0": 4.0, "src1": 2.0, "src2": 0.5}


def op1_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives, _ = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(archives)


def op3_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.languages(table(spark, sf_dir, "documents"))


def op4_bounded_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_poisson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS, default_weight=1.0)


def op6_suffix_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"))


def op7_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_block_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_line_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linerules.line_rules(table(spark, sf_dir, "documents"))


def op10_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.repeated_passages(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_superminhash": op1_superminhash,
    "op2_warc": op2_warc,
    "op3_ppm": op3_ppm,
    "op4_bounded_space": op4_bounded_space,
    "op5_poisson": op5_poisson,
    "op6_suffix_family": op6_suffix_family,
    "op7_ftrl": op7_ftrl,
    "op8_block_pruning": op8_block_pruning,
    "op9_line_first": op9_line_first,
    "op10_chaining": op10_chaining,
}

OP5_SQL = """
with sizes as (select source s, count(*) n, case source when 'src0' then 4.0::double when 'src1' then 2.0::double when 'src2' then 0.5::double else 1.0::double end w from documents group by source),
sums as (select sum(w) w, sum(n)::double n from sizes),
rates as (select s, sizes.w * sums.n / sums.w / sizes.n rate from sizes, sums),
keyed as (select d.*, rate, greatest(1, ceil(rate / 8.0)::int) parts, '17|' || coalesce(doc_id::varchar, '?') || '|' || coalesce(md5(text), '?') k from documents d join rates on d.source is not distinct from s),
drawn as (select keyed.* exclude (parts, rate), rate / parts m, ('0x' || substr(md5(k || '|' || i), 1, 13))::bigint / 4503599627370496.0::double u from keyed, unnest(range(1, parts + 1)) t(i)),
steps as (select *, list_reduce(list_transform(range(0, 41), lambda j: {'k': j, 'p': exp(-m), 'f': exp(-m), 'n': 0}), lambda a, b: {'k': b.k, 'p': a.p * m / b.k, 'f': a.f + a.p * m / b.k, 'n': a.n + case when a.f <= u then 1 else 0 end}).n c from drawn),
counted as (select doc_id, text, lang, source, n_chars, k, sum(c)::bigint c from steps group by all)
select doc_id, text, lang, source, n_chars, i::int as copy, md5('shuffle|' || k || '|' || i) shuffle_key from counted, unnest(range(1, c + 1)) t(i)
"""

OP6_SQL = """
with h as (select doc_id, hex(encode(coalesce(text, ''))) h from documents),
parts as (select doc_id, c, substr(h, 1024 * c + 1, 1122) part from h, unnest(range(0, (length(h) // 2 + 511) // 512)) t(c)),
win as (select doc_id, 512 * c + q p, md5(substr(part, 2 * q - 1, 100)) g from parts, unnest(range(1, least(512, length(part) // 2 - 49) + 1)) t(q)),
first_doc as (select g, min(doc_id) m from win group by 1),
hit as (select doc_id, p from win join first_doc using (g) where m < doc_id),
runs as (select doc_id, p, sum(case when p <= before + 50 then 0 else 1 end) over (partition by doc_id order by p) k from (select doc_id, p, lag(p) over (partition by doc_id order by p) before from hit)),
spans as (select doc_id, k, min(p) a, max(p) + 49 z from runs group by 1, 2),
gaps as (select doc_id, a, z, coalesce(lag(z) over (partition by doc_id order by a), 0) y from spans),
kept as (select doc_id, count(*) s, sum(z - a + 1) r, string_agg(substr(h, 2 * y + 1, 2 * (a - 1 - y)), '' order by a) || substr(any_value(h), 2 * max(z) + 1) k from gaps join h using (doc_id) group by 1)
select h.doc_id, (length(h) // 2)::bigint n_bytes, coalesce(r, 0)::bigint n_removed, coalesce(s, 0)::bigint n_spans, sha256(unhex(coalesce(k, h))) kept_sha256 from h left join kept using (doc_id)
"""

OP8_SQL = """
with good as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) v from embeddings where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
terms as (select vec_id, unnest(v) x, generate_subscripts(v, 1) t from good),
scores as (select q.vec_id query_id, c.vec_id, sum(q.x * c.x)::bigint score from terms q join terms c on q.t = c.t and q.vec_id <> c.vec_id where q.vec_id % 100 = 0 group by all),
ranked as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as "rank", vec_id, score from scores)
select query_id, "rank", vec_id, score from ranked where "rank" <= 10
"""

OP1_SQL = """
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') ws from documents),
s as (select distinct doc_id, case when len(ws) = 1 then ws[1] else ws[i] || ' ' || ws[i + 1] end g from w, unnest(range(1, greatest(len(ws), 2))) t(i) where len(ws) > 0),
n as (select doc_id, count(*) k from s group by 1),
met as (select a.doc_id x, b.doc_id y, count(*) c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
links as (select x, y from met join n p on p.doc_id = x join n q on q.doc_id = y where 100 * c >= 80 * (p.k + q.k - c)),
reach(x, y) as (select x, y from links union select r.x, l.y from reach r join links l on r.y = l.x),
low as (select x, min(y) m from reach group by 1)
select d.doc_id, coalesce(n.k, 0)::bigint n_shingles, least(d.doc_id, coalesce(low.m, d.doc_id)) component_id, d.doc_id = least(d.doc_id, coalesce(low.m, d.doc_id)) kept
from documents d left join n on n.doc_id = d.doc_id left join low on low.x = d.doc_id
"""

OP2_SQL = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) n, sha1(coalesce(html, '')) d from pages),
q as (select *, case when n >= 1000 then max(page_id) over (partition by d) end m from p)
select page_id, n::bigint payload_bytes, d payload_digest, case when m is not null and page_id is distinct from m then 'revisit' else 'response' end record_type, case when page_id is distinct from m then m end refers_to from q
"""

OP9_SQL = """
with d as (select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') ws from documents),
lines as (select doc_id, l, row_number() over (partition by doc_id, l) again, regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+') lw from (select doc_id, unnest(string_split(t, chr(10))) l from d)),
full_lines as (select *, len(lw) n, len(list_filter(lw, lambda x: x in ('|', '>'))) bars, length(regexp_replace(l, '[^#*$%&|<>]', '', 'g')) marks, length(regexp_replace(l, '[^A-Z]', '', 'g')) caps, length(regexp_replace(l, '[^A-Za-z]', '', 'g')) letters from lines where len(lw) > 0),
judged as (select *, (len(list_filter(lw, lambda x: regexp_matches(x, '[.!?"'':;)”’…»。]$'))) = 0) or 2 * marks > n or (bars >= 2 and 5 * bars >= n) or (letters >= 10 and 2 * caps > letters) or regexp_matches(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '__PHRASES__') bad from full_lines),
sums as (select doc_id, count(*) filter (again > 1) dups, count(*) filter (bad) bad_lines, coalesce(sum(n) filter (bad), 0) bad_words from judged group by 1),
win as (select doc_id, i, count(*) over (partition by doc_id, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) c from d, unnest(range(1, len(ws) - 1)) t(i)),
reps as (select doc_id, count(distinct i + k) r from win, unnest(range(0, 3)) t(k) where c > 1 group by 1),
v as (select d.doc_id, len(ws)::bigint n_words, length(array_to_string(ws, ''))::bigint word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols, coalesce(dups, 0)::bigint n_dup_lines, coalesce(r, 0)::bigint n_repeat_words, coalesce(bad_lines, 0)::bigint n_failed_lines, coalesce(bad_words, 0)::bigint n_failed_words from d left join sums on sums.doc_id = d.doc_id left join reps on reps.doc_id = d.doc_id),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed from v)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and 100 * n_failed_words <= __LOSS__ * n_words kept, n_failed_lines, n_failed_words from b
""".replace("__PHRASES__", "|".join(linerules.PHRASES)).replace("__LOSS__", str(linerules.LOSS))

SQL: dict[str, str] = {
    "op1_superminhash": OP1_SQL,
    "op6_suffix_family": OP6_SQL,
    "op9_line_first": OP9_SQL,
    "op2_warc": OP2_SQL,
    "op5_poisson": OP5_SQL,
    "op8_block_pruning": OP8_SQL,
}
