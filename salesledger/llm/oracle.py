"""DuckDB checks of the text operators whose results the contract and the documented thresholds settle.

Each follows the definition, not the method: exact shingle sets for every pair that shares one, every string of 100 bytes,
every n-gram as a list of words. They are for small tables.
"""

from __future__ import annotations

from salesledger.llm import quality, suffix

WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"
#: Texts are cut into chunks that overlap, so that DuckDB need not walk a whole text for every place.
CHUNK = 256
SIZES = sorted({quality.WINDOW, *quality.COVERAGE_LIMITS})
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

QUALITY = rf"""
with texts as (
  select row_number() over () as n, doc_id, coalesce(text, '') as text from documents
),
words as (
  select n, unnest(found) as word, generate_subscripts(found, 1) as i
  from (select n, regexp_extract_all(text, '{WORD}') as found from texts)
),
grams as (
  select n, i, word, size,
    list(word) over (partition by n, size order by i rows between current row and {max(SIZES) - 1} following)[1:size] as gram
  from words cross join (select unnest({SIZES}) as size)
),
twice as (
  select n, i, word, size, len(gram) = size and count(*) over (partition by n, size, gram) > 1 as again from grams
),
inside as (
  select n, word, size, bool_or(again) over (partition by n, size order by i rows between (size - 1) preceding and current row) as again
  from twice
),
covered as (
  select n,
    count(*) filter (size = {quality.WINDOW}) as n_words,
    sum(length(word)) filter (size = {quality.WINDOW}) as word_chars,
    count(*) filter (size = {quality.WINDOW} and again) as n_repeat_words,
    {", ".join(f"coalesce(sum(length(word)) filter (size = {k} and again), 0) as chars_{k}" for k in quality.COVERAGE_LIMITS)}
  from inside group by n
),
lines as (
  select n, length(regexp_replace(line, '{BLANK}', '', 'g')) as chars, row_number() over (partition by n, line order by j) > 1 as again
  from (
    select n, unnest(found) as line, generate_subscripts(found, 1) as j
    from (select n, string_split(text, chr(10)) as found from texts)
  )
  where regexp_matches(line, '{WORD}')
),
line_counts as (
  select n, count(*) filter (again) as n_dup_lines, coalesce(sum(chars) filter (again), 0) as line_chars from lines group by n
),
counted as (
  select doc_id, cast(coalesce(n_words, 0) as bigint) as n_words, cast(coalesce(word_chars, 0) as bigint) as word_chars,
    cast(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols,
    cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines, cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words,
    greatest(coalesce(word_chars, 0), 1)::double as most, coalesce(line_chars, 0) as line_chars,
    {", ".join(f"coalesce(chars_{k}, 0) as chars_{k}" for k in quality.COVERAGE_LIMITS)}
  from texts left join covered using (n) left join line_counts using (n)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and line_chars::double / most <= {quality.LINE_LIMIT}::double
    and {" and ".join(f"chars_{k}::double / most <= {limit}::double" for k, limit in quality.COVERAGE_LIMITS.items())} as kept
from counted
"""

NEAR_DUPLICATES = rf"""
with recursive texts as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') as found from documents
),
words as (
  select doc_id, len(found) as n_words, unnest(found) as word, generate_subscripts(found, 1) as i from texts
),
shingles as (
  select distinct doc_id, array_to_string(gram, ' ') as shingle
  from (
    select doc_id, n_words, i, list(word) over (partition by doc_id order by i rows between current row and 2 following) as gram from words
  )
  where len(gram) = 3 or (n_words < 3 and i = 1)
),
sizes as (select doc_id, count(*) as size from shingles group by doc_id),
common as (
  select a.doc_id as a, b.doc_id as b, count(*) as shared
  from shingles a join shingles b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id
),
links as (
  select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b
  where 100 * shared >= 85 * (x.size + y.size - shared)
),
reached as (
  select doc_id, doc_id as other from documents
  union
  select reached.doc_id, links.b as other from reached join links on links.a = reached.other
),
classes as (select doc_id, min(other) as component_id from reached group by doc_id)
select doc_id, cast(coalesce(size, 0) as bigint) as n_shingles, component_id, doc_id = component_id as kept
from classes left join sizes using (doc_id)
"""

REPEATS = f"""
with texts as (
  select row_number() over (order by doc_id) as n, doc_id, strlen(coalesce(text, '')) as n_bytes, hex(coalesce(text, '')) as digits
  from documents
),
chunks as (
  select n, n_bytes, base, substr(digits, 2 * base + 1, {2 * (CHUNK + suffix.LENGTH)}) as digits
  from (select n, n_bytes, digits, unnest(range(0, n_bytes, {CHUNK})) as base from texts)
),
places as (
  select n, base + k as pos, substr(digits, 2 * k + 1, 2) as byte,
    case when base + k + {suffix.LENGTH} <= n_bytes then md5(substr(digits, 2 * k + 1, {2 * suffix.LENGTH})) end as string
  from (select n, n_bytes, base, digits, unnest(range(least({CHUNK}, n_bytes - base))) as k from chunks)
),
repeats as (
  select n, pos, byte, string is not null and row_number() over (partition by string order by n, pos) > 1 as again from places
),
covered as (
  select n, pos, byte, bool_or(again) over (partition by n order by pos rows between {suffix.LENGTH - 1} preceding and current row) as gone
  from repeats
),
edges as (
  select n, pos, byte, gone, gone and not coalesce(lag(gone) over (partition by n order by pos), false) as opens from covered
),
counted as (
  select n, count(*) filter (gone) as n_removed, count(*) filter (opens) as n_spans,
    string_agg(byte, '' order by pos) filter (not gone) as kept
  from edges group by n
)
select doc_id, cast(n_bytes as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed,
  cast(coalesce(n_spans, 0) as bigint) as n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256
from texts left join counted using (n)
"""

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

SEARCH = rf"""
with docs as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') as terms from documents
),
asked as (
  select row_number() over () as q, item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') as terms from benchmark
),
wanted as (select q, item_id, unnest(terms) as term from asked),
held as (select r, doc_id, cast(len(terms) as bigint) as n, unnest(terms) as term from docs),
sizes as (select cast(count(*) as bigint) as n_docs, cast(sum(len(terms)) as bigint) as n_terms from docs where len(terms) > 0),
found as (
  select r, doc_id, n, term, cast(count(*) as bigint) as tf from held where term in (select term from wanted) group by all
),
weights as (
  select term, cast(floor(1000 * ln(cast(2 * n_docs + 2 as double) / cast(2 * count(*) + 1 as double))) as bigint) as w
  from found cross join sizes group by term, n_docs
),
scores as (
  select q, item_id, r, doc_id,
    cast(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) as bigint) as score
  from wanted join found using (term) join weights using (term) cross join sizes
  group by q, item_id, r, doc_id
)
select item_id, cast(row_number() over (partition by q order by score desc, doc_id nulls last) as integer) as rank, doc_id, score
from scores where score > 0
qualify rank <= 20
"""


def _clusters(k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1) -> str:
    far = f"list_sum([(v.x[i] - c.x[i]) * (v.x[i] - c.x[i]) for i in range(1, {dims + 1})])"
    step = """
near{r} as (
  select n, c, d from (select v.n, c.c, {far} as d from kept v cross join cent{r} c)
  qualify row_number() over (partition by n order by d, c) = 1
)"""
    move = """
sums{r} as (
  select c, i, sum(v) as s, count(*) as m
  from (select n, unnest(x) as v, generate_subscripts(x, 1) as i from kept) join near{r} using (n) group by c, i
),
means{r} as (select c, list(cast((s - ((s % m) + m) % m) // m as bigint) order by i) as x from sums{r} group by c),
cent{n} as (select c, coalesce(means{r}.x, cent{r}.x) as x from cent{r} left join means{r} using (c))"""
    parts = [step.format(r=r, far=far) + ("," + move.format(r=r, n=r + 1) if r < rounds else "") for r in range(rounds + 1)]
    return f"""
with kept as (
  select row_number() over () as n, vec_id, [cast(floor({scale} * cast(y as double)) as bigint) for y in embedding] as x
  from embeddings where len(embedding) = {dims} and len([y for y in embedding if y is not null and isfinite(y)]) = {dims}
),
cent0 as (
  select row_number() over (order by sha256('{seed}:' || vec_id) nulls last, x) - 1 as c, x from kept qualify c < {k}
),{",".join(parts)}
select vec_id, cast(c as integer) as cluster, cast(d as bigint) as distance, cast(sum(d) over (partition by c) as bigint) as cluster_inertia,
  cast(sum(d) over () as bigint) as inertia, sha256(array_to_string(cent{rounds}.x, ',')) as centroid_sha256
from near{rounds} join kept using (n) join cent{rounds} using (c)
"""


ORACLE_SQL = {
    "op3_quality": QUALITY, "op6_near_duplicates": NEAR_DUPLICATES, "op7_suffix_dedup": REPEATS,
    "op11_lexical_search": SEARCH, "op12_clusters": _clusters(),
}
