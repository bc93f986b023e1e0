"""The operators applied to whole tables, as registered queries with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from townmeter.llm import bpe, licenses, merkle, mixing, near_duplicates, neighbours, pii, quality, records, sharding, spans, spelling, url_filter
from townmeter.llm.common import table
from townmeter.sources.shared import fresh_dir


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of a public vocabulary, the byte-level one if none is named."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows to every twentieth row of embeddings."""
    return neighbours.search(table(spark, sf_dir, "embeddings"), every=20)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents over 24 equal shards, and over one more."""
    return sharding.assign(table(spark, sf_dir, "documents"), [1.0] * 24, grown=1.0)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of each document."""
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that lose repeated sentence spans."""
    return spans.cut_repeats(table(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License rules that each document meets."""
    return licenses.licenses(table(spark, sf_dir, "documents"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on each page's URL."""
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's ids and of what they decode to."""
    return bpe.encode(table(spark, sf_dir, "documents"), vocabulary())


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in each document."""
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share 80 % of their 4-word shingles."""
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), k=4)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with the forms that they are variants of."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle manifest of documents, held against rows of which some are lower-cased."""
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    return merkle.manifest(table(spark, sf_dir, "documents"), altered={"text": tampered}).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each document, read back from the record files that they were written to."""
    path = fresh_dir(spark, "records")
    records.write_records(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"), end_id=1)
    return records.read_records(spark, path, give_ids=False)


def queries() -> dict:
    return {f.__name__: f for f in (op1_neighbours, op2_sharding, op3_quality, op4_mixing, op5_spans, op6_licenses, op7_urls, op8_bpe, op9_pii, op10_near_duplicates, op11_spelling, op12_merkle, op13_records)}


_WORDS = r"list_filter(regexp_split_to_array(coalesce({text}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _quality_cells(value: str) -> str:
    return f"case when {value} < 64 then {value} else ({value} >> (length(bin({value})) - 6)) << (length(bin({value})) - 6) end"


def quality_sql(docs: str = "documents") -> str:
    """A WITH list that ends in `quality`: docs with counts, base_failed and kept."""
    names = [k for k, *_ in quality.MEASURES]
    values = " union all ".join(f"select lang, source, '{k}' as measure, {k} as v from measured where not base_failed" for k in names)
    over = " or ".join(f"coalesce(m.{k} > t.{k}, false)" for k in names)
    ratios = ", ".join(f"case when {b} > 0 then 1000 * ({a}{f' - ceil(sqrt({a}::double))::bigint' * rare}) // {b} else 0 end as {k}" for k, a, b, rare in quality.MEASURES)
    own = ", ".join(f"max(q90 + {quality.RARE_FENCE if rare else quality.FENCE} * (q90 - q50) + {quality.LEAST}) filter (where measure = '{k}') as {k}" for k, _, _, rare in quality.MEASURES)
    blend = lambda a, b: ", ".join(f"(({a}.docs * {a}.{k} + {quality.PRIOR} * {b}.{k}) // ({a}.docs + {quality.PRIOR}))::bigint as {k}" for k in names)
    return rf"""
texts as (select row_number() over () as rid, *, {_WORDS.format(text='text')} as w from {docs}),
windows as (select rid, pos, w[pos] || ' ' || w[pos + 1] || ' ' || w[pos + 2] as win
            from (select rid, w, unnest(range(1, len(w) - 1)) as pos from texts where len(w) >= 3)),
twice as (select rid, pos from (select rid, pos, count(*) over (partition by rid, win) as n from windows) where n > 1),
repeats as (select rid, count(distinct p) as n from (select rid, unnest([pos, pos + 1, pos + 2]) as p from twice) group by rid),
counted as (
  select t.rid, doc_id, text, lang, source, n_chars, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
         length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) as n_symbols,
         len(ls) as n_lines, len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words
  from (select *, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) as ls from texts) t
  left join repeats r on r.rid = t.rid),
measured as (select *, n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words as base_failed, {ratios} from counted),
vals as (select lang, source, measure, {_quality_cells('v')} as cell from ({values})),
levels as (select 0 as level, lang, source, measure, cell from vals union all select 1, lang, null, measure, cell from vals union all select 2, null, null, measure, cell from vals),
hist as (select level, lang, source, measure, cell, count(*) as n from levels group by all),
running as (select *, sum(n) over (partition by level, lang, source, measure order by cell) as upto, sum(n) over (partition by level, lang, source, measure) as docs from hist),
cuts as (select level, lang, source, measure, min(cell) filter (where 100 * upto >= 50 * docs) as q50, min(cell) filter (where 100 * upto >= 90 * docs) as q90, max(docs) as docs
         from running group by all),
limits as (select level, lang, source, max(docs) as docs, {own} from cuts group by all),
by_lang as (select l.lang, {blend('l', 'o')} from (from limits where level = 1) l cross join (from limits where level = 2) o),
thresholds as (select g.lang, g.source, g.docs, {blend('g', 'l')} from (from limits where level = 0) g join by_lang l on g.lang is not distinct from l.lang),
quality as (select m.*, not base_failed and not ({over}) as kept
            from measured m left join thresholds t on m.lang is not distinct from t.lang and m.source is not distinct from t.source)"""


def mixing_sql(docs: str = "documents") -> str:
    """SQL of the mix over docs with doc_id, text, source."""
    return rf"""
sized as (select doc_id, source, len(w) as size, case when len(w) = 0 then 1.0::double else greatest(0.05::double, len(list_distinct(w))::double / len(w)::double) end as weight
          from (select doc_id, source, {_WORDS.format(text='text')} as w from {docs})),
sources as (select source, sum(size)::bigint as source_size from sized group by source),
weighted as (select *, [3.0::double, 1.0::double, 2.0::double][1 + (row_number() over (order by source nulls last) - 1) % 3] as sw, 2.0::double * source_size as cap from sources),
levels as (select *, cap / sw as full_at,
             (1.5::double * sum(source_size) over () - coalesce(sum(cap) over (order by cap / sw, source nulls last rows between unbounded preceding and 1 preceding), 0.0))
             / sum(sw) over (order by cap / sw, source nulls last rows between current row and unbounded following) as level from weighted),
fixed as (select *, first_value(case when full_at > level then level end ignore nulls) over (order by full_at, source nulls last rows between unbounded preceding and current row) as f from levels),
plan as (select source, source_size, case when f is null then cap else f * sw end as target from fixed),
whole as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as epochs from plan),
drawn as (select s.doc_id, s.size, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size as rest,
            sum(s.size) over (partition by s.source order by -ln((('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 13))::bigint::double + 0.5) / 4503599627370496.0::double) / s.weight, doc_id, s.size rows unbounded preceding) as upto
          from sized s join whole p on s.source is not distinct from p.source)
select doc_id, size, source_size, target, (size * (epochs + case when upto - size / 2 <= rest then 1 else 0 end))::bigint as taken from drawn"""


def licenses_sql() -> str:
    known = ", ".join(f"('{i}', '{s}')" for i, s in licenses._PLAIN.items())
    met = lambda which: f"list_filter([{', '.join(f"case when regexp_matches(rest, '{licenses.pattern(s)}') then '{i}' end" for i, s in which.items())}], lambda x: x is not null)"
    slots = {i: s for i, s in licenses.SENTENCES.items() if i not in licenses._PLAIN}
    rules = " union all ".join(
        f"select doc_id, '{rule}' as rule, '{name}' as license, n_sentences, list_min(list_transform(list_filter(found, lambda x: x.sentence_id = '{seq[0]}'), lambda x: x.place)) as first_place from lines where regexp_matches(line, '{licenses.sequence(seq)}')"
        for rule, name, seq in licenses.RULES
    )
    return rf"""
with known(sentence_id, sentence) as (values {known}),
cut as (select doc_id, regexp_split_to_array(text, '{licenses.MARK_END}') as parts from documents where regexp_matches(text, '{licenses.TRIGGER}')),
pieces as (select doc_id, parts, unnest(parts) as part, unnest(range(len(parts))) as i from cut),
wrapped as (select doc_id, coalesce(list_sum(list_transform(parts[1:i], lambda x: len(string_split(x, chr(10))))), 0)::bigint as before,
              list_transform(string_split(part, chr(10)), lambda x: trim(regexp_replace(lower(x), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))) as ls from pieces where regexp_matches(part, '{licenses.TRIGGER}')),
starts as (select doc_id, before + j as place, ls[j + 1] as sentence, len(ls) as n, array_to_string(ls[j + 1:j + {licenses.MOST_LINES}], chr(10)) || chr(10) as rest from (select *, unnest(range(len(ls))) as j from wrapped) where ls[j + 1] <> ''),
hits as (select doc_id, place, sentence_id from starts join known using (sentence) union select doc_id, place, unnest({met(licenses._PLAIN)}) from starts where n > 1 union select doc_id, place, unnest({met(slots)}) from starts),
lines as (select doc_id, count(*) as n_sentences, ',' || string_agg(sentence_id, ',,' order by place, sentence_id) || ',' as line, list({{'place': place, 'sentence_id': sentence_id}}) as found from hits group by doc_id)
select doc_id, rule, license, n_sentences, first_place::bigint as first_place from ({rules})"""


def urls_sql() -> str:
    host = " ".join(
        f"when regexp_matches(site, '{r.pattern}') then '{r.name}'" for r in sorted((r for r in url_filter.RULES if r.length), key=lambda r: -r.length)
    )
    verdict = " ".join(f"when '{r.name}' then '{r.verdict}'" for r in url_filter.RULES if r.length)
    patterns = " ".join(f"when regexp_matches(low, '{r.pattern}') then '{r.name}'" for r in url_filter.RULES if not r.length)
    return rf"""
with rests as (select page_id, case when position('://' in coalesce(url, '')) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages),
sites as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from rests),
ruled as (select *, case {host} end as rule, case {patterns} end as any_pattern from (select *, host || path as site, translate(host || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low from sites))
select page_id, host, path, rule, case when rule is not null then case rule {verdict} end when any_pattern is not null then 'block' else 'allow' end as verdict,
       case when rule is null then any_pattern end as pattern from ruled"""


#: A table of one row with the 256 steps of CRC-32, from its polynomial.
_CRC_STEPS = "select list(step order by i) as steps from (select i, list_reduce(list_prepend(i, range(8)::bigint[]), lambda c, _: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as step from (select unnest(range(256)) as i))"


def _crc32(text: str) -> str:
    """Unsigned crc32 of a text's UTF-8 bytes, where `steps` is in scope."""
    hexed = f"hex(encode({text}))"
    codes = f"list_transform(range(1, length({hexed}), 2), lambda i: ('0x' || substr({hexed}, i, 2))::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {codes}), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295::bigint)"


def spelling_sql() -> str:
    return rf"""
with recursive crc as ({_CRC_STEPS}),
runs as (select coalesce(doc_id::varchar, '') || ':' as k, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) as run from documents),
hashed as (select run, {_crc32("k || run")} as h from runs cross join crc where length(run) >= {spelling.MIN_LENGTH}),
typed as (select case when h % {spelling.ERROR_RATE} = 0 then substr(run, 1, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2) else run end as word from hashed),
counted as (select word, count(*) as n from typed where length(word) >= {spelling.MIN_LENGTH} group by word having count(*) >= {spelling.MIN_COUNT}),
holes as (select word, n, i, substr(word, 1, i) || substr(word, i + 2) as rest from (select word, n, unnest(range(length(word))) as i from counted)),
near as (select a.word, b.word as other, b.n from holes a join holes b on a.rest = b.rest and a.i = b.i and a.word <> b.word
         union select a.word, b.word, b.n from holes a join counted b on a.rest = b.word union select b.word, a.word, a.n from holes a join counted b on a.rest = b.word),
best as (select word, count(*) as n_near, max(n) as most, min(other) filter (where n = top) as other from (select *, max(n) over (partition by word) as top from near) group by word),
formed as (select c.word, c.n, coalesce(n_near, 0) as n_near, case when most >= {spelling.RATIO} * c.n then other end as form, case when most >= {spelling.RATIO} * c.n then most end as form_n from counted c left join best using (word)),
walk(word, last) as (select word, word from formed union all select w.word, f.form from walk w join formed f on f.word = w.last where f.form is not null),
roots as (select w.word, w.last as root from walk w join formed f on f.word = w.last where f.form is null)
select word, form, root, n, n_near, form_n from formed join roots using (word)"""


#: Levels of the SQL's trees: 8 ** 9 leaves a language.
_SQL_LEVELS = 9


def _climb(name: str, leaves: str) -> str:
    """A WITH list of the levels `{name}0` and so on above leaves (g, i, d), and of {name}_path: (g, i, path of siblings before and after by level) of each leaf."""
    joined = "string_agg({0}, '' order by i)"
    out = [f"{name}0 as (select g, i, d, count(*) over (partition by g) as m from ({leaves}))"]
    for k in range(_SQL_LEVELS):
        up = f"select g, i // 8 as i, case when max(m) > 1 then sha256({joined.format('d')}) else max(d) end as d, case when max(m) > 1 then (max(m) + 7) // 8 else 1 end as m from {name}{k} group by g, i // 8"
        out.append(f"{name}{k + 1} as ({up})")
        run = f"partition by g, i // 8 order by i rows between"
        around = lambda a, b: f"coalesce(string_agg(d, '') over ({run} {a} and {b}), '')"
        out.append(f"{name}s{k} as (select g, i, m, {around('unbounded preceding', '1 preceding')} as a, {around('1 following', 'unbounded following')} as b from {name}{k})")
    steps = ", ".join(f"case when s{k}.m > 1 then {{'a': s{k}.a, 'b': s{k}.b}} end" for k in range(_SQL_LEVELS))
    joins = " ".join(f"join {name}s{k} s{k} on s{k}.g is not distinct from s0.g and s{k}.i = s0.i // {8 ** k}" for k in range(1, _SQL_LEVELS))
    out.append(f"{name}_path as (select s0.g, s0.i, list_filter([{steps}], lambda x: x is not null) as path from {name}s0 s0 {joins})")
    return ",\n".join(out)


def merkle_sql() -> str:
    field = lambda c: f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"
    leaf = lambda text: f"sha256(concat({field('doc_id')}, {field('source')}, {field('lang')}, {field('n_chars')}, {field(text)}))"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
with crc as ({_CRC_STEPS}),
leaves as (select doc_id, lang as g, {leaf('text')} as leaf, case when {_crc32("doc_id::varchar")} % 3 = 0 then {leaf(lowered)} else {leaf('text')} end as other from documents cross join crc),
placed as (select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as i from leaves),
{_climb('l', 'select g, i, leaf as d from placed')},
subroots as (select g, d as subroot, row_number() over (order by g nulls first) - 1 as j from l{_SQL_LEVELS}),
{_climb('r', 'select 0 as g, j as i, subroot as d from subroots')},
paths as (select p.doc_id, p.leaf, p.other, s.subroot, t.d as root, list_concat(lp.path, rp.path) as path
          from placed p join l_path lp on lp.g is not distinct from p.g and lp.i = p.i join subroots s on s.g is not distinct from p.g join r_path rp on rp.i = s.j cross join r{_SQL_LEVELS} t),
folded as (select *, sha256(array_to_string(list_transform(path, lambda x: x.a || x.b), '')) as proof_sha256,
             list_reduce(list_prepend({{'a': other, 'b': ''}}, path), lambda d, x: {{'a': sha256(x.a || d.a || x.b), 'b': ''}}).a as folded_root from paths)
select doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root as verified from folded"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_quality": f"with {quality_sql()} select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept from quality",
        "op4_mixing": f"with {mixing_sql()}",
        "op6_licenses": licenses_sql(),
        "op7_urls": urls_sql(),
        "op11_spelling": spelling_sql(),
        "op12_merkle": merkle_sql(),
    }
