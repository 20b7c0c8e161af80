"""The queries of this subpackage over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import decontamination, html_extract, langid, line_dedup, packing, pii, quality, simhash, token_store, warc

VOCABULARY = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row_hash")


#: Common words of the test tables, near each other in some documents.
PHRASES = {"three": "the of and", "pair": "que los", "one": "und"}


def decontamination_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of a phrase's first word with all its words at most three away, counted by phrase and document."""
    index = decontamination.build_index(table(spark, sf_dir, "documents"))
    return decontamination.proximity(index, PHRASES, 3).groupBy("phrase", "doc_id").agg(F.count("*").alias("n"), F.min("place").alias("first_place"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans(table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_digest(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = (
    op1_pattern_packing, op2_token_store, op3_decontamination, op4_html_extraction, op5_personal_data,
    op6_language, op7_warc, op8_line_dedup, op9_quality_rules, op10_simhash, decontamination_proximity,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


_LINES = r"""
with lines as (
    select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as place
    from documents
), keyed as (
    select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines
), shared as (
    select key, min(doc_id) as first_doc from keyed where length(key) >= 10 group by key having count(distinct doc_id) >= 2
), marked as (
    select keyed.*, first_doc is not null and doc_id <> first_doc as lost from keyed left join shared using (key)
)
select doc_id, count(*) as n_lines, count(*) filter (where lost) as n_dropped,
    sha256(coalesce(string_agg(line, chr(10) order by place) filter (where not lost), '')) as kept_sha256
from marked group by doc_id
"""

_WINDOWS = r"""
with words as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') as w from documents
), item_words as (
    select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') as w from benchmark
), windows as (
    select distinct item_id, least(10, len(w)) as n, w[i : i + least(10, len(w)) - 1] as win
    from (select item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as i from item_words where len(w) > 0)
), places as (
    select doc_id, i, n, w[i : i + n - 1] as win
    from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from words, (select distinct n from windows) where len(w) >= n)
), found as (
    select places.doc_id, places.i, places.n, item_id from places join windows using (n, win)
), hit as (
    select doc_id, count(distinct place) as n_hit from (select doc_id, unnest(range(i, i + n)) as place from found) group by doc_id
), items as (
    select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as joined from (select distinct doc_id, item_id::varchar as item from found) group by doc_id
)
select words.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(joined, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from words left join hit using (doc_id) left join items using (doc_id)
"""


_PROXIMITY = r"""
with words as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') as w from documents
), places as (
    select doc_id, unnest(w) as word, unnest(range(0, len(w))) as place from words
), phrases(phrase, first_word, others) as (
    values ('three', 'the', ['of', 'and']), ('pair', 'que', ['los']), ('one', 'und', []::varchar[])
), wanted as (
    select phrase, unnest(others) as other from phrases
), near as (
    select distinct p.phrase, a.doc_id, a.place, o.word from phrases p join places a on a.word = p.first_word join wanted w on w.phrase = p.phrase join places o on o.doc_id = a.doc_id and o.word = w.other and abs(o.place - a.place) <= 3
), full_ones as (
    select phrase, doc_id, place from near join phrases using (phrase) group by phrase, doc_id, place having count(*) = any_value(len(others))
    union all select p.phrase, a.doc_id, a.place from phrases p join places a on a.word = p.first_word where len(p.others) = 0
)
select phrase, doc_id, count(*) as n, min(place)::bigint as first_place from full_ones group by phrase, doc_id
"""

_ARCHIVE = r"""
with hashed as (
    select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as h from pages
), best as (
    select *, max(page_id) over (partition by h) as last_id from hashed
)
select page_id, payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, 5 * (i // 4) + 1, 5))::int) >> (15 - 5 * (i % 4))::int) & 31) + 1, 1) for i in range(32)], '') as payload_digest,
    case when page_id = last_id then 'response' else 'revisit' end as record_type, case when page_id <> last_id then last_id end as refers_to
from best
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_line_dedup": _LINES, "op3_decontamination": _WINDOWS, "op7_warc": _ARCHIVE, "decontamination_proximity": _PROXIMITY}
