"""The registered queries of the text operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from loomgrid.llm import audit, bpe, html_density, langid, oddsketch, ogg, packing, quality, radix, simhash, substring, urlrep, whitening
from loomgrid.llm.common import read


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of whole texts, learned on the folds that are not held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = langid.held_out()
    model = langid.train(docs.where(~held))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality.quality_rules(docs, read(spark, sf_dir, "labels")).select("doc_id", *quality.FEATURES, "base_failed", "kept")


def op4_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_density.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op5_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.media_digest(read(spark, sf_dir, "documents"))


def op6_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.hex_of().alias("fingerprint"), "component_id")


def op8_large_item_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_radix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = radix.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"), with_kept=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    outcomes = urlrep.page_outcomes(pages, read(spark, sf_dir, "labels"))
    return urlrep.filter_urls(pages, outcomes).select("page_id", "host", "path", "rule", "verdict")


def op11_tiled_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(read(spark, sf_dir, "embeddings"))


def op12_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oddsketch.near_sets(read(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_language_id, op2_byte_bpe, op3_quality_rules, op4_text_density, op5_ogg, op6_difference_cover, op7_simhash_pivots, op8_large_item_matching, op9_host_reputation, op10_radix_repeats,
             op11_tiled_whitening, op12_odd_sketches, op13_filter_audit]
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def _op9_sql() -> str:
    two = ", ".join(f"'{x}'" for x in urlrep.TWO_LABEL_SUFFIXES)
    fits = []
    for what, rule in sorted(urlrep.RULES, key=lambda r: -len(r[1])):
        name, slash, rest = rule.partition("/")
        fits.append((f"(host = '{name}' or ends_with(host, '.{name}')) and starts_with(path, '{slash}{rest}')", rule, what))
    rule_case = " ".join(f"when {c} then '{r}'" for c, r, _ in fits)
    what_case = " ".join(f"when {c} then '{w}'" for c, _, w in fits)

    def strength(children: str, by: str) -> str:
        return f"""select {by}, case when v <= 0 or noise <= 0 then {urlrep.MAX_STRENGTH} else least(greatest(noise / v - 1, {urlrep.MIN_STRENGTH}), {urlrep.MAX_STRENGTH}) end strength from (
            select *, (ss - k * noise) / greatest(m - k, 1) v from (select {by}, sum(n * (bad / n - prior) * (bad / n - prior)) ss, count(*) k, sum(n) m, max(prior) * (1 - max(prior)) noise from {children} group by {by}))"""

    def posterior(children: str, strengths: str, by: str) -> str:
        return f"select c.*, prior * strength + bad as alpha, (1 - prior) * strength + n - bad as beta from {children} c join {strengths} s using ({by})"

    return f"""
    with parts as (
        select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
            coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') path from pages),
    worst as (select doc_id, max(case when quality = 0 or toxic = 1 then 1 else 0 end) bad from labels where doc_id is not null group by doc_id),
    numbered as (select host, regexp_extract(path, '^/[a-z]+/([0-9]{{1,18}})', 1) number from parts),
    seen as (select host, w.bad from (select * from numbered where number <> '') t join worst w on w.doc_id = cast(number as bigint) where host <> ''),
    split as (select host, string_split(host, '.') p, count(*) n, sum(bad) bad from seen group by host),
    hosts as (select host, n, bad, case when array_to_string(p[-2:], '.') in ({two}) then array_to_string(p[-2:], '.') else p[-1] end suffix,
        case when array_to_string(p[-2:], '.') in ({two}) then array_to_string(p[-3:], '.') else array_to_string(p[-2:], '.') end domain from split),
    domains as (select suffix, domain, sum(n) n, sum(bad) bad from hosts group by all),
    suffixes as (select suffix, sum(n) n, sum(bad) bad, 0 as one from domains group by suffix),
    top as (select (coalesce(sum(bad), 0) + 0.5) / (coalesce(sum(n), 0) + 1.0) prior from suffixes),
    s0 as (select suffixes.*, prior from suffixes, top),
    s as ({posterior("s0", "(" + strength("s0", "one") + ")", "one")}),
    d0 as (select d.*, alpha / (alpha + beta) prior from domains d join (select suffix, alpha, beta from s) using (suffix)),
    d as ({posterior("d0", "(" + strength("d0", "suffix") + ")", "suffix")}),
    h0 as (select h.*, alpha / (alpha + beta) prior from hosts h join (select suffix, domain, alpha, beta from d) using (suffix, domain)),
    h as ({posterior("h0", "(" + strength("h0", "suffix, domain") + ")", "suffix, domain")}),
    bounds as (select host, alpha / (alpha + beta) - {urlrep.Z} * sqrt(alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1))) bound from h)
    select page_id, host, path, case {rule_case} end as rule, coalesce(case {what_case} end, case when bound > {urlrep.LIMIT} then 'block' else 'allow' end) as verdict
    from parts left join bounds using (host)
    """


_OP6_SQL = r"""
with docs as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents),
starts as (select doc_id, ws, unnest(range(1, len(ws) - 18)) i from docs where len(ws) >= 20),
windows as (select doc_id, i, array_to_string(ws[i:i + 19], ' ') w from starts),
later as (select doc_id, i, row_number() over (partition by w order by doc_id, i) nth from windows),
gone as (select distinct doc_id, unnest(range(i, i + 20)) i from later where nth > 1),
words as (select doc_id, unnest(ws) w, generate_subscripts(ws, 1) i from docs),
kept as (select w.doc_id, count(g.i) n_removed, coalesce(string_agg(w.w, ' ' order by w.i) filter (where g.i is null), '') text
    from words w left join gone g on g.doc_id = w.doc_id and g.i = w.i group by w.doc_id)
select d.doc_id, cast(len(ws) as bigint) n_words, coalesce(n_removed, 0) n_removed, sha256(coalesce(k.text, '')) kept_sha256 from docs d left join kept k using (doc_id)
"""


_OP12_SQL = r"""
with recursive docs as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents),
sets as (select doc_id, list_sort(list_distinct(case when len(ws) >= 3 then list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))
    when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end)) s from docs),
kinds as (select s, len(s) n, min(doc_id) id from sets group by s),
items as (select id, n, unnest(s) x from kinds where n > 0),
pairs as (select a.id a, b.id b from items a join items b on a.x = b.x and a.id < b.id group by a.id, a.n, b.id, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both_ways as (select a, b from pairs union all select b, a from pairs),
reach as (select id a, id b from kinds union select r.a, l.b from reach r join both_ways l on r.b = l.a),
least as (select a id, min(b) component_id from reach group by a),
named as (select doc_id, n, case when n > 0 then component_id else doc_id end component_id from sets join kinds using (s) join least using (id))
select doc_id, n n_shingles, component_id, doc_id = component_id kept from named
"""

_OP13_SQL = r"""
with docs as (select doc_id, coalesce(source, '') part, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents),
firsts as (select t, min(doc_id) first_id from docs group by t),
marks as (select doc_id, max(case when quality = 1 then 1 else 0 end) good, max(case when toxic = 1 then 1 else 0 end) toxic from labels group by doc_id),
fails as (select doc_id, part, coalesce(good, 0) good, coalesce(toxic, 0) toxic,
    {'A': len(ws) < 200, 'B': 100 * len(list_distinct(ws)) < 50 * len(ws), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t), 'D': regexp_matches(t, '[#$%&*|]'),
     'E': coalesce(doc_id > first_id, false)} f from docs join firsts using (t) left join marks using (doc_id)),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) l),
orders as (select a.l || b.l || c.l || d.l || e.l o from letters a, letters b, letters c, letters d, letters e
    where len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
combined as (select part, f.A a, f.B b, f.C c, f.D d, f.E e, f.A::int + f.B::int + f.C::int + f.D::int + f.E::int many, count(*) n, sum(good) good, sum(toxic) toxic from fails group by all),
steps as (select o, unnest(range(1, 6)) step from orders),
judged as (select part, o, step, n, good, toxic, many, case o[step] when 'A' then a when 'B' then b when 'C' then c when 'D' then d else e end fail,
    coalesce(list_bool_or(list_transform(range(1, step), lambda i: case o[i] when 'A' then a when 'B' then b when 'C' then c when 'D' then d else e end)), false) gone from combined, steps),
told as (select part, o filter_order, step, sum(case when not gone and not fail then n else 0 end) kept, sum(case when not gone and fail then n else 0 end) removed, sum(case when gone and fail then n else 0 end) redundant,
    sum(case when fail and many = 1 then n else 0 end) unique_fails, sum(case when not gone and fail then good else 0 end) good_lost, sum(case when not gone and fail then toxic else 0 end) toxic_lost from judged group by all)
select part, filter_order, cast(step as integer) step, cast(kept as bigint) kept, cast(removed as bigint) removed, cast(redundant as bigint) redundant, cast(unique_fails as bigint) unique_fails,
    cast(good_lost as bigint) good_lost, cast(toxic_lost as bigint) toxic_lost, cast(sum(removed) over (partition by part, filter_order[step]) as bigint) shapley from told
"""


def oracle_sql() -> dict[str, str]:
    """SQL twins over whole tables.  The others have none (learned models, tokenizers, parsers, XXH64, 400-byte windows); tests hold them against brute force."""
    return {"op6_difference_cover": _OP6_SQL, "op9_host_reputation": _op9_sql(), "op12_odd_sketches": _OP12_SQL, "op13_filter_audit": _OP13_SQL}
