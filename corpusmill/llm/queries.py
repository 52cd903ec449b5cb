"""The package's queries, each over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import chat, html, media, mixing, packing, quality, simhash, tokencount, topk, warc
from corpusmill.session import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op2_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_swapped(table(spark, sf_dir, "conversations"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.features(media.as_images(table(spark, sf_dir, "documents")), ["doc_id", "n_bytes"])
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_type", "mismatch", F.size("embedded").alias("embedded"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_simhash, op2_preference_format, op3_best_fit_packing, op4_exact_top_k, op5_html_main_text, op6_warc_round_trip, op7_quality_classifier, op8_media_columns, op9_source_mixing, op10_token_counts)
}

_MESSAGES = """with m as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null and turn is not null),
 la as (select conv_id, max(turn) last_turn, arg_max(text, turn) reply from m where role = 'assistant' group by 1),
 rj as (select m.* from m left join la using (conv_id) where last_turn is null or turn < last_turn union all select a.conv_id, a.last_turn, 'assistant', b.reply from la a join la b on b.conv_id = xor(a.conv_id, 1)),
 fk as (select coalesce(a.conv_id, b.conv_id) conv_id, min(coalesce(a.turn, b.turn)) fork from m a full join rj b on a.conv_id = b.conv_id and a.turn = b.turn where a.role is distinct from b.role or a.text is distinct from b.text group by 1),
 pt as (select m.*, case when fork is null or turn < fork then 'prompt' else 'chosen' end part from m left join fk using (conv_id) union all select rj.*, 'rejected' from rj join fk using (conv_id) where turn >= fork),
 sg as (select *, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) seg from pt),
 ps as (select conv_id, sum(length(seg)) n from sg where part = 'prompt' group by 1),
 at_ as (select sg.*, (case part when 'prompt' then 0 else coalesce(n, 0) end + sum(length(seg)) over (partition by conv_id, part order by turn))::bigint fin from sg left join ps using (conv_id)),
 tr as (select *, part <> 'prompt' and role = 'assistant' trained from at_)"""
_BASE32 = "array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, ((i // 4) * 5 + 1)::int, 5))::bigint >> (15 - 5 * (i % 4))::int) & 31)::int, 1)), '')"

#: The other operators need digests, fingerprints, tokenizers or parsers that SQL does not have.
ORACLE_SQL: dict[str, str] = {
    # one message a turn, as in the table; the order of several at a turn is that of their digests
    "op2_preference_format": _MESSAGES + """ select conv_id pair_id, part, turn, row_number() over (partition by conv_id, part, turn)::bigint nth, role, seg segment, fin - length(seg) as "start", fin as "end",
 case when trained then fin - length(seg) + length(role) + 5 else fin end train_from, case when trained then fin - 8 else fin end train_to from tr""",
    "op4_exact_top_k": """with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) e from embeddings where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
 s as (select q.vec_id query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint score from v q join v c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id)
 select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as "rank", vec_id, score from s qualify row_number() over (partition by query_id order by score desc, vec_id) <= 20""",
    "op6_warc_round_trip": f"""with p as (select page_id, coalesce(html, '') h, sha1(coalesce(html, '')) hex, max(page_id) over (partition by coalesce(html, '')) kept from pages)
 select page_id, octet_length(encode(h))::bigint payload_bytes, {_BASE32} payload_digest, case when page_id = kept then 'response' else 'revisit' end record_type, case when page_id <> kept then kept end refers_to from p""",
}
