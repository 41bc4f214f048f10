"""Queries of the operators, as ``__spark_entry__`` registers them, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from plumbline.llm.tokencount import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.sharding import shard

    return shard(_table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from plumbline.llm.pieces import encode

    return encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.suffixtree import score

    return score(_table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.pii import find

    return find(_table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.quality import judge

    found = judge(_table(spark, sf_dir, "documents"), ["doc_id"])
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return found.select("doc_id", *(F.col(f"#{c}").alias(c) for c in names))


#: Words and lines by the same definitions; the hosts' prior by the method of moments.
OP6_SQL = r"""
with w as (
  select doc_id, source, text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls
  from documents),
g as (select doc_id, unnest(range(1, len(ws) - 1)) i, ws from w where len(ws) >= 3),
h as (select doc_id, i, count(*) over (partition by doc_id, ws[i], ws[i + 1], ws[i + 2]) c from g),
r as (select doc_id, count(distinct i + k) n from h, (values (0), (1), (2)) t(k) where c > 1 group by doc_id),
c as (
  select w.doc_id, coalesce(source, '') host, len(ws)::bigint n_words,
    length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g'))::bigint word_chars,
    (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')))::bigint n_symbols,
    (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines, len(ls) lines, coalesce(r.n, 0)::bigint n_repeat_words
  from w left join r using (doc_id)),
f as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed,
    2 * (100 * n_symbols > 30 * n_words)::int + (100 * n_dup_lines > 30 * lines)::int + 2 * (not word_chars between 2 * n_words and 15 * n_words)::int soft
  from c),
hosts as (select host, count(*) n, count(*) filter (where base_failed or soft > 1) f from f group by host),
p as (select avg(f / n) m, var_pop(f / n) v from hosts),
k as (select m, case when v > 0 then least(1000.0, greatest(1.0, m * (1 - m) / v - 1)) else 1000.0 end k from p),
bad as (select host, (m * k + f) / (k + n) > 0.5 bad from hosts, k)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and soft <= case when bad then 0 else 1 end kept
from f join bad using (host)
"""


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.repeats import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.simhash import near_duplicates

    found = near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.htmltext import extract

    return extract(_table(spark, sf_dir, "pages"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.decontam import matches

    found = matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "n_words", F.round("similarity", 6).alias("similarity"))


#: All windows that start with a shingle of the item, or end with the text, compared exactly.
OP10_SQL = r"""
with iw as (
  select item_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from benchmark),
i as (select item_id, w, len(w) n, least(len(w), 5) k from iw where len(w) > 0),
ip as (select item_id, n, k, w, unnest(range(1, n - k + 2)) p from i),
ish as (select item_id, n, k, array_to_string(w[p:p + k - 1], ' ') s, count(*) c from ip group by all),
d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
ks as (select distinct k from i),
dp as (select doc_id, len(w) words, w, k, unnest(range(1, len(w) - k + 2)) p from d, ks),
ds as (select doc_id, words, k, p - 1 pos, array_to_string(w[p:p + k - 1], ' ') s from dp),
h as (select doc_id, words, item_id, n, k, pos, s, c, least(n, words) - k + 1 v, n - k + 1 m from ds join ish using (k, s)),
pair as (select doc_id, item_id from h group by all having count(*) >= any_value(0.8 / 1.8 * (m + v)) - 0.000001),
st as (select distinct doc_id, item_id, least(pos, words - least(n, words)) st from h semi join pair using (doc_id, item_id)),
e as (select st.doc_id, st.item_id, st, any_value(n) n, any_value(m) m, any_value(v) v, s, least(count(*), any_value(c)) x
  from st join h on st.doc_id = h.doc_id and st.item_id = h.item_id and pos between st and st + v - 1 group by all),
f as (select doc_id, item_id, st, any_value(n) n, sum(x) / (any_value(m) + any_value(v) - sum(x)) sim from e group by all)
select doc_id, item_id, arg_min(st, (-sim, st))::bigint start, any_value(n)::int n_words, round(max(sim), 6) similarity
from f where sim >= 0.799999999 group by doc_id, item_id
"""


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.phrases import collocations

    return collocations(_table(spark, sf_dir, "documents"))


#: Every contiguous phrase of up to five words, counted as text; scores in 128-bit whole numbers.
OP11_SQL = r"""
with d as (
  select coalesce(lang, 'und') lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) piece
  from documents),
p as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') w from d),
g as (select lang, w, k, unnest(range(1, len(w) - k + 2)) i from p, (values (1), (2), (3), (4), (5)) t(k)),
f as (select lang, k, array_to_string(w[i:i + k - 1], ' ') phrase, count(*) c from g group by all),
n as (select lang, sum(c)::hugeint n from f where k = 1 group by lang),
q as (select lang, k, phrase, c, string_split(phrase, ' ') w from f where k > 1 and c >= 100),
x as (select lang, c, array_to_string(w[:k - 1], ' ') phrase from q where k > 2 union select lang, c, array_to_string(w[2:], ' ') from q where k > 2),
cuts as (select lang, phrase, w, k, c a, unnest(range(1, k)) j from q where not exists (select 1 from x where x.lang = q.lang and x.phrase = q.phrase and x.c = q.c)),
s as (
  select cuts.lang, cuts.phrase, a, j, l.c l, r.c r, n, (1000 * a::hugeint * n) // (l.c::hugeint * r.c::hugeint) score
  from cuts join n on n.lang = cuts.lang
  join f l on l.lang = cuts.lang and l.phrase = array_to_string(w[:j], ' ')
  join f r on r.lang = cuts.lang and r.phrase = array_to_string(w[j + 1:], ' ')),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, j) = 1),
o as (select lang, row_number() over (partition by lang order by score desc, a desc, phrase)::bigint rank, phrase, a, l, r, n, score from b)
select lang, rank, phrase, a::bigint a, l::bigint l, r::bigint r, n::bigint n, score::bigint score from o where rank <= 2000
"""


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.classifier import score

    return score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.whitening import whiten

    return whiten(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_sharding": op2_sharding,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_lm_scores": op4_lm_scores,
    "op5_pii": op5_pii,
    "op6_quality_rules": op6_quality_rules,
    "op7_repeats": op7_repeats,
    "op8_simhash": op8_simhash,
    "op9_html_text": op9_html_text,
    "op10_decontamination": op10_decontamination,
    "op11_phrases": op11_phrases,
    "op12_quality_classifier": op12_quality_classifier,
    "op13_embedding_whitening": op13_embedding_whitening,
}

ORACLES: dict[str, str] = {"op6_quality_rules": OP6_SQL, "op10_decontamination": OP10_SQL, "op11_phrases": OP11_SQL}
