"""The queries opN_<name> and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wardlight.llm import centroid_lang, fertility, fill_middle, kneser_ney, lattice, minimax_shard, mixing, ngram_join, piece_codec, surrogate, tree_extract, turn_repair, two_fit_pack
from wardlight.llm.common import materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.apply_rules(_table(spark, sf_dir, "documents"))


def op2_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count().alias("n_tokens"))
    docs = materialize(docs)
    n = docs.agg({"n_tokens": "sum"}).first()[0] or 0
    return mixing.mix(docs, "n_tokens", budget=n, entropy_share=0.97, max_repeats=4.0)


def op3_lattice_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op4_tree_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_extract.extract(_table(spark, sf_dir, "pages"))


def op5_centroid_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_lang.identify(_table(spark, sf_dir, "documents"))


def op6_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = kneser_ney.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "lang", "perplexity", "threshold", "kept")


def op7_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minimax_shard.shard(_table(spark, sf_dir, "documents"))


def op8_best_two_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return two_fit_pack.pack(_table(spark, sf_dir, "documents"))


def op9_surrogate_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogate.replace_entities(docs, key=surrogate.session_key(spark))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents")).drop("text_hash")


def op11_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.digests(piece_codec.round_trip(_table(spark, sf_dir, "documents")))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(fill_middle.transform(_table(spark, sf_dir, "documents")))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.digests(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_tokeniser_fertility": op1_tokeniser_fertility,
    "op2_temperature_mixing": op2_temperature_mixing,
    "op3_lattice_near_dedup": op3_lattice_near_dedup,
    "op4_tree_extraction": op4_tree_extraction,
    "op5_centroid_language": op5_centroid_language,
    "op6_kneser_ney_quality": op6_kneser_ney_quality,
    "op7_minimax_sharding": op7_minimax_sharding,
    "op8_best_two_fit_packing": op8_best_two_fit_packing,
    "op9_surrogate_generation": op9_surrogate_generation,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_piece_round_trip": op11_piece_round_trip,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_conversation_repair": op13_conversation_repair,
}
#: What SQL can state: the exact links and components that the two similarity joins must find, cuts by lists of units, and the cheapest edits row by row.
ORACLE_SQL: dict[str, str] = {
    "op3_lattice_near_dedup": """
        with recursive v as (select vec_id, embedding::double[] e from embeddings where embedding is not null and len(embedding) > 0 and list_dot_product(embedding::double[], embedding::double[]) > 0),
        l as (select a.vec_id a, b.vec_id b from v a join v b on a.vec_id <> b.vec_id where list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.9),
        r as (select vec_id a, vec_id c from embeddings union select r.a, l.b from r join l on r.c = l.a),
        m as (select a, min(c) c from r group by 1), n as (select a, count(*) n from l group by 1)
        select vec_id, coalesce(n, 0)::bigint n_links, c component_id, vec_id = c kept from embeddings join m on vec_id = m.a left join n on vec_id = n.a""",
    "op10_ngram_jaccard_join": """
        with recursive w as (select doc_id, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') w from documents where text is not null),
        s as (select distinct doc_id, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[i:i + 4], ' ') end g from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) i from w where len(w) > 0)),
        n as (select doc_id, count(*) n from s group by 1),
        c as (select a.doc_id a, b.doc_id b, count(*) k from s a join s b using (g) where a.doc_id <> b.doc_id group by 1, 2),
        l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where k >= 0.8 * (x.n + y.n - k)),
        r as (select doc_id a, doc_id c from documents union select r.a, l.b from r join l on r.c = l.a),
        m as (select a, min(c) c from r group by 1), t as (select a, count(*) n from l group by 1)
        select doc_id, c class_id, coalesce(n, 0)::bigint n_links, doc_id = c kept from documents join m on doc_id = m.a left join t on doc_id = t.a""",
    "op12_fill_in_middle": r"""
        with d as (select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') u, sha256('1:' || coalesce(doc_id::varchar, '')) s from documents),
        h as (select *, len(u) n, ('0x' || s[1:8])::bigint h1, ('0x' || s[9:16])::bigint h2, ('0x' || s[17:24])::bigint h3, ('0x' || s[25:32])::bigint h4 from d),
        c as (select *, least(h1 % (n + 1), h2 % (n + 1)) a, greatest(h1 % (n + 1), h2 % (n + 1)) b, case when t = '' or regexp_matches(t, '<[PSM]>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end form from h),
        p as (select *, coalesce(array_to_string(u[1:a], ''), '') pre, coalesce(array_to_string(u[a + 1:b], ''), '') mid, coalesce(array_to_string(u[b + 1:n], ''), '') suf from c)
        select doc_id, n, form, case when form <> 'plain' then length(pre) end prefix_chars, case when form <> 'plain' then length(mid) end middle_chars,
        sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) output_sha256, sha256(t) restored_sha256 from p""",
    "op13_conversation_repair": r"""
        with recursive tab as (select list(v order by i) tab from (select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) v from range(256) t(i))),
        b as (select *, list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: unicode(x)::bigint) bytes from conversations),
        g as (select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') as text, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % 20 draw from b, tab),
        m as (select conv_id, turn, case when draw = 4 then 'user' else role end role, case draw when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case when draw = 3 then 2 else 1 end)) from g where draw <> 0),
        o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) i from m),
        n as (select *, row_number() over (partition by conv_id, role, text order by i) seen, right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) tail from o),
        r as (select *, left(role, 1) ini, case when tail = '' then 1 when seen > 1 then 2 when tail in ('.', '!', '?') then 0 else 3 end flaw from n),
        ins as (select * from (values (0, '', 0, ''), (0, 'I', 2, 'user:'), (0, 'II', 3, 'user:' || chr(10) || 'assistant:'), (1, '', 1, ''), (1, 'I', 2, 'user:'), (1, 'II', 3, 'user:' || chr(10) || 'assistant:'), (2, '', 2, ''), (2, 'I', 3, 'assistant:'), (3, '', 3, ''), (3, 'I', 2, 'user:')) x(s, ed, s2, lines)),
        eds as (select * from (values ('K', 0, 's', 1), ('K', 0, 'u', 2), ('K', 1, 'u', 2), ('K', 2, 'a', 3), ('K', 3, 'u', 2), ('R', 0, null, 2), ('R', 1, null, 2), ('R', 2, null, 3), ('R', 3, null, 2), ('D', 0, null, 0), ('D', 1, null, 1), ('D', 2, null, 2), ('D', 3, null, 3)) x(ed, s2, ini, ns)),
        w as (select distinct conv_id c, 0::bigint i, 0 s, 0::bigint cost, '' audit, '' txt from r union all
        select c, i + 1, ns, best.cost, best.audit, best.txt from (select c, i, ns, min({'cost': cost, 'audit': audit, 'txt': txt}) best from (
        select w.c, w.i, eds.ns, w.cost + 2 * length(ins.ed) + case eds.ed when 'D' then 3 when 'R' then 2 else 0 end + case when r.flaw = 3 and eds.ed <> 'D' then 1 else 0 end as cost, w.audit || ins.ed || eds.ed audit,
        w.txt || case when ins.lines <> '' then ins.lines || chr(10) else '' end || case eds.ed when 'D' then '' when 'K' then r.role || ':' || r.text || chr(10) else case eds.ns when 2 then 'user' else 'assistant' end || ':' || r.text || chr(10) end txt
        from w join r on r.conv_id is not distinct from w.c and r.i = w.i + 1 join ins on ins.s = w.s join eds on eds.s2 = ins.s2 and (eds.ed = 'D' or r.flaw in (0, 3) and (eds.ed = 'R' or eds.ini = r.ini))) group by all)),
        z as (select conv_id, max(i) n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (where flaw = 1) blank, count(*) filter (where flaw = 2) dup, count(*) filter (where flaw = 3) cut from r group by 1),
        q as (select conv_id, count(*) illegal from (select conv_id, ini, lag(ini) over (partition by conv_id order by i) p, i from r) where i > 1 and p || ini not in ('su', 'ua', 'au') group by 1),
        f as (select c, min({'cost': cost + case s when 1 then 4 when 2 then 2 else 0 end, 'audit': audit || case s when 1 then 'II' when 2 then 'I' else '' end, 'txt': txt || case s when 1 then 'user:' || chr(10) || 'assistant:' || chr(10) when 2 then 'assistant:' || chr(10) else '' end}) best
        from w join z on z.conv_id is not distinct from w.c and w.i = z.n group by 1)
        select y.conv_id, coalesce(z.gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(dup, 0) duplicate, coalesce(cut, 0) truncated, coalesce(illegal, 0) illegal, coalesce(best.cost, 0) as cost, coalesce(best.audit, '') audit, sha256(coalesce(best.txt[:-2], '')) repaired_sha256
        from (select distinct conv_id from conversations) y left join z using (conv_id) left join q using (conv_id) left join f on f.c = y.conv_id""",
}
