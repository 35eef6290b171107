"""The registered queries of this subpackage and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mendseq.llm import (adaptive_scan, byte_cnn, chat, chunk_bpe, context_mixing, golay_simhash, html_region, license_scan, order_minhash, packing,
                         phrase_mining, spelling_variants, toxicity)
from mendseq.llm.common import table
from mendseq.session import materialize


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprint_edits(table(spark, sf_dir, "documents"))


def op2_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_bpe.encode(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts are the template's own controls."""
    said = "</s>[INST] ok [/INST]"
    hostile = spark.sql(f"select * from values (-1L, 0L, 'user', '{said}'), (-1L, 1L, 'assistant', '{said}') "
                        "as t(conv_id, turn, role, text)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(hostile)
    return chat.digests(materialize(chat.render(chat.fold(chat.events_of(rows))), "formatted"))


def op6_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golay_simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.score(table(spark, sf_dir, "documents"))


def op8_html_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_region.extract(pages, html_region.fit(pages))


def op9_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return byte_cnn.identify(docs, byte_cnn.fit(docs))


def op10_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adaptive_scan.nearest(table(spark, sf_dir, "embeddings"))


def op11_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.summarize(license_scan.scan(table(spark, sf_dir, "documents")))


def op12_toivonen_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.collocations(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(spelling_variants.vocabulary(table(spark, sf_dir, "documents")))


def _escaped(column: str) -> str:
    for plain, code in chat.ESCAPES:
        column = f"replace({column}, '{plain}', '{code}')"
    return column


_CHAT = f"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all
  select * from (values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')))
select cast(conv_id as bigint) as conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(9 + length({_escaped("role")}) + length({_escaped("text")})) as bigint) as formatted_chars
from rows group by conv_id"""


_PHRASES = r"""
with docs as (
  select coalesce(lang, 'und') as lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
pieces as (select lang, unnest(string_split_regex(text, '[.,;:!?\n\x0B\x0C\r]')) as piece from docs),
listed as (select lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') as w from pieces),
places as (select lang, w, unnest(range(1, len(w) + 1)) as i from listed),
grams as (
  select lang, size, array_to_string(w[i:i + size - 1], ' ') as phrase
  from places, (values (1), (2), (3)) as s(size) where i + size - 1 <= len(w)),
f as (select lang, size, phrase, count(*) as n from grams group by all),
totals as (select lang, cast(sum(n) as bigint) as n from f where size = 1 group by lang),
candidates as (select lang, size, phrase, n as a, string_split(phrase, ' ') as w from f where size > 1 and n >= 10),
split as (
  select lang, size, phrase, a, w, unnest(range(1, size)) as k from candidates),
parts as (
  select lang, size, phrase, a, k, array_to_string(w[1:k], ' ') as head, array_to_string(w[k + 1:], ' ') as rest from split),
cuts as (
  select p.*, x.n as l, y.n as r, cast((1000000::hugeint * a * a) // (x.n::hugeint * y.n) as bigint) as score
  from parts p join f as x on x.lang = p.lang and x.phrase = p.head join f as y on y.lang = p.lang and y.phrase = p.rest),
worst as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inner_pairs as (
  select lang, array_to_string(w[1:2], ' ') as phrase, a from candidates where size = 3
  union all select lang, array_to_string(w[2:3], ' ') as phrase, a from candidates where size = 3),
longest as (select lang, phrase, max(a) as most from inner_pairs group by all),
kept as (
  select w.* from worst w left join longest g on g.lang = w.lang and g.phrase = w.phrase and w.size = 2
  where g.most is null or 100 * g.most < 50 * w.a)
select kept.lang, row_number() over (partition by kept.lang order by score desc, a desc, encode(phrase)) as rank,
  phrase, a, l, r, totals.n, score
from kept join totals on totals.lang = kept.lang
qualify rank <= 2000"""


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_order_minhash, op2_chunk_bpe, op3_toxicity, op4_best_fit_packing, op5_chat_events, op6_golay_simhash, op7_context_mixing, op8_html_region, op9_byte_cnn,
                                    op10_adaptive_scan, op11_license_rules, op12_toivonen_phrases, op13_spelling_variants)}


def llm_oracles() -> dict[str, str]:
    return {"op5_chat_events": _CHAT, "op12_toivonen_phrases": _PHRASES}
