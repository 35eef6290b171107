"""The queries once more in plain SQL, for an independent engine."""

from __future__ import annotations


from mendseq.functions.sampling import PRIME, coin_sql
from mendseq.operators.bloom import MIX, SEED_STEP
from contract.correction_oracle import correction
from mendseq.plans.workspace import DEFAULT_K

K = DEFAULT_K

READS = """
o as (
  select o_orderkey as rid, o_orderkey*7919 + o_custkey*104729 as h,
         32*cast(floor((select count(*) from orders)/22) as bigint) as glen
  from orders),
p as (
  select rid, h, cast(h % (glen - 100) as bigint) as st,
         cast(floor(h/7) as bigint) % 100 as ep, cast(floor(h/11) as bigint) % 100 as np
  from o),
b as (select rid, cast(floor(st/32) as bigint) as bk, cast(st % 32 as int) as off,
             cast(ep as int) as ep, cast(np as int) as np from p),
t as (
  select rid, ep, np, substr(concat(
    translate(md5(concat('g', cast(bk   as varchar))), '0123456789abcdef', 'ACGTACGTACGTACGT'),
    translate(md5(concat('g', cast(bk+1 as varchar))), '0123456789abcdef', 'ACGTACGTACGTACGT'),
    translate(md5(concat('g', cast(bk+2 as varchar))), '0123456789abcdef', 'ACGTACGTACGTACGT'),
    translate(md5(concat('g', cast(bk+3 as varchar))), '0123456789abcdef', 'ACGTACGTACGTACGT'),
    translate(md5(concat('g', cast(bk+4 as varchar))), '0123456789abcdef', 'ACGTACGTACGTACGT')),
    off+1, 100) as f0 from b),
e as (
  select rid, np, f0,
    case when rid % 3 = 0 then concat(substr(f0,1,ep), translate(substr(f0,ep+1,1),'ACGT','CGTA'), substr(f0,ep+2)) else f0 end as f1,
    case when rid % 3 = 0 then concat(repeat('I',ep), '#', repeat('I',99-ep)) else repeat('I',100) end as q1 from t),
n as (
  select rid, f0, q1,
    case when rid % 50 = 7 then concat(substr(f1,1,np), 'N', substr(f1,np+2)) else f1 end as f2 from e),
s as (
  select rid,
    case when rid % 2 = 1 then reverse(translate(f0,'ACGT','TGCA')) else f0 end as ts,
    case when rid % 2 = 1 then reverse(translate(f2,'ACGT','TGCA')) else f2 end as sq,
    case when rid % 2 = 1 then reverse(q1) else q1 end as ql from n),
reads as materialized (
  select cast(0 as int) as file_ind, cast(rid as bigint) as read_idx,
    concat('@r', cast(rid as varchar)) as id,
    case when rid % 97 = 5 then substr(sq,1,12) else sq end as seq,
    case when rid % 97 = 5 then substr(ql,1,12) else ql end as qual,
    case when rid % 97 = 5 then substr(ts,1,12) else ts end as true_seq
  from s)"""

# The same reads as other kinds of input.
FASTA_READS = READS.replace("reads as materialized", "with_quality as") + """,
reads as materialized (select file_ind, read_idx, translate(id, '@', '>') as id, seq, cast(null as varchar) as qual from with_quality)"""
TWO_FILES = READS.replace("reads as materialized", "one_file as") + """,
reads as materialized (select cast(read_idx % 2 as int) as file_ind, read_idx, id, seq, qual from one_file)"""

NOISY = """
errs as (select l_orderkey as read_idx, list(distinct (l_partkey*7 + l_suppkey*13 + l_linenumber*17) % 100) as errors
  from lineitem group by l_orderkey),
placed as (select r.*, coalesce(errors, []) as errors from reads r left join errs e on r.read_idx = e.read_idx),
noisy as materialized (select file_ind, read_idx, id,
  array_to_string(list_transform(range(1, length(seq) + 1), lambda i: case when list_contains(errors, i - 1)
    then translate(substr(seq, cast(i as int), 1), 'ACGT', 'GTAC') else substr(seq, cast(i as int), 1) end), '') as seq,
  array_to_string(list_transform(range(1, length(qual) + 1), lambda i: case when list_contains(errors, i - 1) and i % 3 = 0
    then '#' else substr(qual, cast(i as int), 1) end), '') as qual from placed)"""

GENOME = "(32*cast(floor((select count(*) from orders)/22) as bigint))"


def windows(k: int) -> str:
    """All windows with their 0-based start, and the canonical form of the valid ones."""
    return f"""
w0 as (
  select file_ind, read_idx, seq, unnest(range(0, greatest(length(seq) - {k} + 1, 0))) as pos from reads),
w1 as (select file_ind, read_idx, pos, substr(seq, cast(pos + 1 as int), {k}) as km from w0),
windows as materialized (
  select file_ind, read_idx, pos, km, regexp_matches(km, '^[ACGT]+$') as is_valid,
    least(km, reverse(translate(km, 'ACGT', 'TGCA'))) as kmer from w1)"""


ALPHA = f"""
alpha as (select cast(sum(length(seq)) as bigint) as n_bases, sum(length(seq))/{GENOME} as coverage,
  cast(7.0 as double)/(sum(length(seq))/{GENOME}) as alpha from reads)"""

HISTOGRAM = """
ends as (select ascii(substr(qual, 1, 1)) as f, ascii(substr(qual, cast(length(seq) as int), 1)) as l
  from reads),
hist as (select score, cast(sum(is_f) as bigint) as n_first, cast(sum(1 - is_f) as bigint) as n_last from (
  select f as score, 1 as is_f from ends union all select l, 0 from ends) group by score),
cum as (select score, sum(n_first) over w as cf, sum(n_last) over w as cl,
  (select count(*) from ends) as n from hist window w as (order by score))"""

CUTOFF = """
cut as (select cast(least(min(case when cl > 0.05*n then score end),
  min(case when cf > 0.05*n then score end) - 1) as int) as cutoff from cum)"""

SAMPLED = f"""
sampled as (
  select file_ind, read_idx, pos, kmer from windows
  where is_valid and {coin_sql('file_ind', 'read_idx', 'pos')}
    < (select cast(floor(alpha*{PRIME}) as bigint) from alpha)),
a as materialized (select distinct kmer from sampled)"""

THRESHOLDS = f"""
rate as (select 1 - power(1 - alpha, greatest(2, cast(trunc(0.1/alpha*2) as int))) as p from alpha),
binom as (select n, m, cast(factorial(cast(n as int)) as double)/cast(factorial(cast(m as int)) as double)
    /cast(factorial(cast(n - m as int)) as double)*power(p, m)*power(1 - p, n - m) as mass
  from (select n, unnest(range(0, n + 1)) as m from (select unnest(range(1, {K + 1})) as n)), rate),
cdf as (select n, m, sum(mass) over (partition by n order by m) as c from binom),
thresholds as materialized (select n, min(m) as threshold from cdf where c >= 0.995 group by n)"""

COVERAGE = f"""
occurs as (select file_ind, read_idx, pos, case when is_valid and a.kmer is not null then 1 else 0 end as hit
  from windows left join a on windows.kmer = a.kmer),
bases as (select file_ind, read_idx, seq, qual, unnest(range(0, length(seq))) as pos
  from reads where length(seq) >= {K}),
coverage as materialized (
  select b.file_ind, b.read_idx, b.pos, ascii(substr(b.qual, cast(b.pos + 1 as int), 1)) as q,
    count(o.hit) over f as n_windows, coalesce(sum(o.hit) over f, 0) as n_hits
  from bases b left join occurs o on b.read_idx = o.read_idx and b.file_ind = o.file_ind and b.pos = o.pos
  window f as (partition by b.file_ind, b.read_idx order by b.pos rows between {K - 1} preceding and current row)),
trust as materialized (
  select file_ind, read_idx, pos, case when n_hits > threshold and coalesce(q > (select cutoff from cut), true) then 1 else 0 end as trusted
  from coverage join thresholds on n = n_windows)"""

TRUSTED = f"""
kept as (select file_ind, read_idx, pos, sum(trusted) over (
    partition by file_ind, read_idx order by pos rows between current row and {K - 1} following) as n from trust),
b_set as materialized (select distinct w.kmer from windows w join kept on w.file_ind = kept.file_ind
  and w.read_idx = kept.read_idx and w.pos = kept.pos where n = {K} and is_valid)"""

# The same for the noisy reads.
NOISY_WINDOWS = f"""
nw0 as (
  select file_ind, read_idx, seq, unnest(range(0, greatest(length(seq) - {K} + 1, 0))) as pos from noisy),
nw1 as (select file_ind, read_idx, pos, substr(seq, cast(pos + 1 as int), {K}) as km from nw0),
noisy_windows as materialized (
  select file_ind, read_idx, pos, km, regexp_matches(km, '^[ACGT]+$') as is_valid,
    least(km, reverse(translate(km, 'ACGT', 'TGCA'))) as kmer from nw1),
solid as materialized (select file_ind, read_idx, pos,
    case when is_valid and s.kmer is not null then 1 else 0 end as solid
  from noisy_windows left join b_set s on noisy_windows.kmer = s.kmer)"""

SOLID = """
solid as materialized (select file_ind, read_idx, pos,
    case when is_valid and s.kmer is not null then 1 else 0 end as solid
  from windows left join b_set s on windows.kmer = s.kmer)"""

RUNS = """
marked as (select file_ind, read_idx, pos,
    pos - row_number() over (partition by file_ind, read_idx order by pos) as island from solid where solid = 1),
runs as (select file_ind, read_idx, min(pos) as start, count(*) as size from marked
  group by file_ind, read_idx, island)"""

NO_CUTOFF = "cut as (select cast(0 as int) as cutoff)"

PASS1 = [READS, windows(K), ALPHA, SAMPLED]
PASS2 = [*PASS1, HISTOGRAM, CUTOFF, THRESHOLDS, COVERAGE, TRUSTED]


def sql(parts: list[str], body: str) -> str:
    return "with " + ",".join(parts) + "\n" + body


def recursive(parts: list[str], body: str) -> str:
    return "with recursive " + ",".join(parts) + "\n" + body


def _hits(parts: list[str], table: str, flag: str, name: str) -> str:
    return sql(parts, f"""
select r.file_ind, r.read_idx, cast(count(x.pos) as int) as n_windows,
  cast(coalesce(sum(x.{flag}), 0) as int) as {name}, cast(coalesce(sum(x.pos*x.{flag}), 0) as bigint) as pos_sum
from reads r left join {table} x on r.file_ind = x.file_ind and r.read_idx = x.read_idx
group by r.file_ind, r.read_idx""")


# Best change of each read without a trusted k-mer: the longest run over the changed
# base, then the lowest quality, then the first position and base.
ANCHORS = f"""
lost as (select r.* from noisy r where length(seq) >= {K} and not exists (
  select 1 from solid s where s.file_ind = r.file_ind and s.read_idx = r.read_idx and s.solid = 1)),
cells as (select file_ind, read_idx, seq, qual, unnest(range(0, length(seq))) as pos from lost),
changes as (select file_ind, read_idx, qual, length(seq) as len, pos, base,
    concat(substr(seq, 1, cast(pos as int)), base, substr(seq, cast(pos + 2 as int))) as changed
  from (select *, unnest(['A', 'C', 'G', 'T']) as base from cells)
  where base <> substr(seq, cast(pos + 1 as int), 1)),
tried as (select *, unnest(range(greatest(pos - {K - 1}, 0), least(pos, len - {K}) + 1)) as start from changes),
probed as (select t.*, substr(changed, cast(start + 1 as int), {K}) as km from tried t),
found as (select p.*, case when regexp_matches(km, '^[ACGT]+$') and s.kmer is not null then 1 else 0 end as hit
  from probed p left join b_set s on s.kmer = least(km, reverse(translate(km, 'ACGT', 'TGCA')))),
promising as (select file_ind, read_idx, pos, base from found where hit = 1
  and start = least(greatest(pos - cast(floor({K}/2) as bigint) + 1, 0), len - {K})),
islands as (select f.*, start - row_number() over (partition by f.file_ind, f.read_idx, f.pos, f.base order by start) as island
  from found f join promising using (file_ind, read_idx, pos, base) where hit = 1),
scored as (select file_ind, read_idx, pos, base, any_value(qual) as qual, max(n) as run from (
  select file_ind, read_idx, pos, base, any_value(qual) as qual, count(*) as n
  from islands group by file_ind, read_idx, pos, base, island) group by file_ind, read_idx, pos, base),
ranked as (select *, row_number() over (partition by file_ind, read_idx
  order by run desc, ascii(substr(qual, cast(pos + 1 as int), 1)), pos, base) as place from scored)"""


def bloom_sizes(genome: str) -> str:
    return f"""
limits as (select 'a' as name, cast(0.01 as double) as fp union all select 'b', cast(0.0005 as double)),
tries as (select name, unnest(range(2, 1000)) as h, fp from limits),
costs as (select name, h, cast(floor({genome}*1.5) as bigint) as capacity,
  -h*cast(floor({genome}*1.5) as bigint)/ln(1 - power(fp, 1.0/h)) + 256 as bits from tries),
sizes as (select name, capacity, h, bits from costs qualify row_number() over (partition by name order by bits, h) = 1)"""


def bloom_bits(name: str, source: str, p: str) -> list[str]:
    """(kmer, bit): all bits of each k-mer of ``source`` in the filter called ``name``."""
    wrap = 2**64

    def times(x: str, factor: int) -> str:
        return f"cast(cast({x} as uhugeint) * cast({factor} as uhugeint) % cast({wrap} as uhugeint) as ubigint)"

    codes = " + ".join(f"cast(strpos('ACGT', substr(kmer, {i + 1}, 1)) - 1 as bigint)*{4 ** (K - 1 - i)}" for i in range(K))
    return [f"""
{p}_0 as (select kmer, seed, cast((cast({codes} as uhugeint) + cast(seed as uhugeint)*cast({SEED_STEP} as uhugeint))
    % cast({wrap} as uhugeint) as ubigint) as x
  from (select kmer, unnest(range(1, 2 + (select h from sizes where name = '{name}'))) as seed from {source})),
{p}_1 as (select kmer, seed, {times('xor(x, x >> 30)', MIX[0])} as x from {p}_0),
{p}_2 as (select kmer, seed, {times('xor(x, x >> 27)', MIX[1])} as x from {p}_1),
{p}_3 as materialized (select kmer, seed, xor(x, x >> 31) as x from {p}_2),
{p}_bits as materialized (select distinct s.kmer, b.x % (
    select cast(floor(ceil(floor(bits)/8)*8/256) as ubigint) from sizes where name = '{name}')*256 + s.x % 256 as bit
  from {p}_3 s join {p}_3 b on b.kmer = s.kmer and b.seed = 1 where s.seed > 1)"""]


def oracles() -> dict[str, str]:
    solid_pass = [*PASS2, SOLID]
    noisy_pass = [*PASS2, NOISY, NOISY_WINDOWS]
    path = """concat('in/', source, '/', lang, cast(doc_id as varchar), (['.fq', '.fastq', '.fa', '.fasta', '.fq.gz',
      '.fasta.gz', '.txt.gz', '.b.fq', '', 'gz'])[doc_id % 10 + 1])"""
    name = "regexp_extract(path, '([^/]*)$', 1)"
    base = f"""case when ends_with({name}, '.gz')
      then regexp_replace(regexp_replace({name}, '\\.gz$', ''), '\\.(fastq|fasta|fq|fa)$', '')
      else regexp_replace({name}, '\\.[^.]*$', '') end"""
    kind = "case when doc_id % 3 <> 0 then '.cor.fq' else '.cor.fa' end"
    out = {
        "sequencing_reads": sql([READS], "select file_ind, read_idx, id, seq, qual from reads"),
        "noisy_sequencing_reads": sql([READS, NOISY], "select file_ind, read_idx, id, seq, qual from noisy"),
        "read_stats": sql([READS], f"""
select file_ind, count(*) as n_reads, cast(sum(length(seq)) as bigint) as n_bases,
  count(*) filter (not regexp_matches(seq, '^[ACGT]+$')) as n_with_other,
  count(*) filter (length(seq) < {K}) as n_short, cast(min(length(seq)) as int) as min_length, cast(max(length(seq)) as int) as max_length
from reads group by file_ind"""),
        "infer_alpha": sql([READS, ALPHA], """
select n_bases, round(coverage, 6) as coverage, round(alpha, 9) as alpha from alpha"""),
        "quality_histogram": sql([READS, HISTOGRAM], "select score, n_first, n_last from hist"),
        "bad_quality_cutoff": sql([READS, HISTOGRAM, CUTOFF], "select cutoff from cut"),
        "good_quality_cutoff": sql([READS, HISTOGRAM],
                                   "select min(case when cf > 0.25*n then score end) as cutoff from cum"),
        "kmer_extract_counts": sql([READS, windows(K)], """
select file_ind, read_idx, count(*) as n_valid, cast(min(pos) as int) as first_pos, cast(max(pos) as int) as last_pos
from windows where is_valid group by file_ind, read_idx"""),
        "kmer_validity": sql([READS, windows(K)],
                             "select file_ind, is_valid, count(*) as n_windows from windows group by file_ind, is_valid"),
        "kmer_canonical": sql([READS, windows(K)], "select distinct kmer from windows where is_valid"),
        "long_kmers": sql([READS, windows(41)], "select distinct kmer from windows where is_valid"),
        "sample_kmers": sql(PASS1, "select file_ind, read_idx, cast(pos as int) as pos, kmer from sampled"),
        "set_a_distinct": sql(PASS1, "select kmer from a"),
        "binomial_threshold": sql([READS, ALPHA, THRESHOLDS], """
select cast(n as int) as n, cast(threshold as int) as threshold from thresholds"""),
        "kmer_occurrence": _hits([*PASS2], "occurs", "hit", "n_hits"),
        "position_coverage": sql(PASS2, """
select cast(n_windows as int) as n_windows, cast(n_hits as int) as n_hits, count(*) as n_positions,
  cast(sum(pos) as bigint) as pos_sum from coverage group by n_windows, n_hits"""),
        "trusted_positions": sql(PASS2, """
select r.file_ind, r.read_idx, cast(coalesce(sum(trusted), 0) as int) as n_trusted,
  cast(coalesce(sum(pos*trusted), 0) as bigint) as pos_sum
from reads r left join trust t on r.file_ind = t.file_ind and r.read_idx = t.read_idx
group by r.file_ind, r.read_idx"""),
        "trusted_kmers": sql(PASS2, "select kmer from b_set"),
        "trusted_store_roundtrip": sql(PASS2, "select kmer from b_set"),
        "trusted_kmers_joined": sql(PASS2, "select kmer from b_set"),
        "solid_flags": _hits(solid_pass, "solid", "solid", "n_solid"),
        "solid_flags_joined": _hits(solid_pass, "solid", "solid", "n_solid"),
        "solid_semi_join": sql(PASS2, """
select kmer, count(*) as n_occurrences from windows
where is_valid and kmer in (select kmer from b_set) group by kmer"""),
        "non_solid_anti_join": sql(PASS2, """
select kmer, count(*) as n_occurrences from windows
where is_valid and kmer not in (select kmer from b_set) group by kmer"""),
        "longest_solid_run": sql([*solid_pass, RUNS], """
select file_ind, read_idx, cast(start as int) as start, cast(size as int) as size from runs
qualify row_number() over (partition by file_ind, read_idx order by size desc, start) = 1"""),
        "trusted_spans": sql([*solid_pass, RUNS], f"""
select file_ind, read_idx, cast(start as int) as span_start, cast(start + size + {K - 1} as int) as span_end
from runs join reads using (file_ind, read_idx) where start + size < length(seq) - {K} + 1"""),
        "anchor_class": sql([*noisy_pass, RUNS], f"""
select anchor, count(*) as n_reads from (
  select case when length(seq) < {K} then 'too_short' when m is null then 'no_anchor'
    when m = length(seq) - {K} + 1 then 'all_trusted' when m >= {K} then 'long_anchor'
    else 'short_anchor' end as anchor
  from noisy left join (select file_ind, read_idx, max(size) as m from runs group by file_ind, read_idx)
    using (file_ind, read_idx)) group by anchor"""),
        "create_anchor_candidates": sql([*noisy_pass, ANCHORS], """
select file_ind, read_idx, cast(pos as int) as pos, base, cast(run as int) as run from ranked where place = 1"""),
        "set_ops_a_b": sql(PASS2, """
select kmer, 'both' as side from a where kmer in (select kmer from b_set)
union all select kmer, 'only_a' from a where kmer not in (select kmer from b_set)
union all select kmer, 'only_b' from b_set where kmer not in (select kmer from a)"""),
        "output_names": f"""
with d as (select doc_id, {path} as path from documents)
select doc_id, concat({base}, {kind}, case when ends_with(path, 'gz') then '.gz' else '' end) as output,
  concat({base}, {kind}) as plain_output from d""",
        "bloom_sizing": f"""
with {bloom_sizes(GENOME)}
select name, capacity, cast(h as int) as hashes, cast(ceil(floor(bits)/8)*8 as bigint) as bits from sizes""",
        "high_error_adaptation": sql([*PASS1, HISTOGRAM, CUTOFF, bloom_sizes(GENOME), """
fps as (select load, power(1 - exp(-h*load*(select count(*) from a)/(ceil(floor(bits)/8)*8)), h) as fp
  from sizes, (select unnest([1, 2, 3]) as load) where name = 'a')"""], """
select load, case when fp > 0.1 then 5 else 4 end as max_corrections,
  case when fp > 0.1 and cutoff > 0 then cutoff + 1 else cutoff end as cutoff, round(fp, 9) as fp
from fps, cut"""),
        "bloom_membership": sql([*PASS2, bloom_sizes(GENOME), *bloom_bits("b", "b_set", "f"), """
everything as (select distinct kmer from windows where is_valid)""", *bloom_bits("b", "everything", "e"), """
filled as (select distinct bit from f_bits),
maybe as (select e.kmer, count(*) = count(f.bit) as maybe from e_bits e left join filled f on f.bit = e.bit group by e.kmer),
marked as (select maybe, maybe.kmer in (select kmer from b_set) as in_b from maybe)"""], """
select count(*) filter (in_b) as n_members, count(*) filter (in_b and not maybe) as n_missed,
  count(*) filter (not in_b and maybe) as n_false from marked"""),
        "bloom_occupancy": sql([*PASS1, bloom_sizes(GENOME), *bloom_bits("a", "a", "f"), """
blocks as (select bit // 256 as block, count(distinct bit) as n from f_bits group by bit // 256),
total as (select floor(ceil(floor(bits)/8)*8/256) as n_blocks, h from sizes where name = 'a')"""], """
select round(sum(n)/(any_value(n_blocks)*256), 9) as occupancy,
  round(sum(power(n/256.0, h))/any_value(n_blocks), 9) as false_positive from blocks, total"""),
        "fastx_roundtrip": sql([READS], """
select file_ind, row_number() over (order by read_idx) - 1 as read_idx, id, seq, qual from reads"""),
        "gzip_ranges_roundtrip": sql([READS], """
select file_ind, row_number() over (order by read_idx) - 1 as read_idx, id, seq, qual from reads"""),
        "fastx_roundtrip_fasta": sql([FASTA_READS], """
select file_ind, row_number() over (order by read_idx) - 1 as read_idx, id, seq, qual from reads"""),
        "paired_files_roundtrip": sql([TWO_FILES], """
select file_ind, row_number() over (partition by file_ind order by read_idx) - 1 as read_idx, id, seq, qual from reads"""),
        "documents_kmers": f"""
with reads as (select cast(0 as int) as file_ind, doc_id as read_idx,
  regexp_replace(upper(text), '[^ACGTN]', '', 'g') as seq from documents), {windows(K)}
select kmer, count(*) as n_occurrences from windows where is_valid group by kmer""",
    }
    result = "select file_ind, read_idx, seq, qual, correction, bad_prefix, bad_suffix, info from corrected"
    noisy = [*PASS2, NOISY]
    out.update({
        "correct_reads": recursive([*PASS2, *correction("reads")], result),
        "correct_reads_joined": recursive([*PASS2, *correction("reads")], result),
        "correct_with_loaded_kmers": recursive([*PASS2, *correction("reads")], result),
        "correct_reads_fasta": recursive(
            [FASTA_READS, windows(K), ALPHA, SAMPLED, NO_CUTOFF, THRESHOLDS, COVERAGE, TRUSTED, *correction("reads")],
            result.replace("qual", "cast(null as varchar) as qual")),
        "correct_reads_noqual": recursive(
            [*PASS1, NO_CUTOFF, THRESHOLDS, COVERAGE, TRUSTED, *correction("reads", new_quality="#")], result),
        "correct_reads_two_files": recursive(
            [TWO_FILES, windows(K), ALPHA, SAMPLED, HISTOGRAM, CUTOFF, THRESHOLDS, COVERAGE, TRUSTED, *correction("reads")],
            result.replace("file_ind", "cast(read_idx % 2 as int) as file_ind")),
        "pipeline_modelled": recursive(
            [*PASS1, bloom_sizes(f"(({GENOME})//3)"), """
fp as (select power(1 - exp(-h*(select count(*) from a)/(ceil(floor(bits)/8)*8)), h) as fp from sizes where name = 'a')""",
             HISTOGRAM, CUTOFF.replace("cut as", "first_cut as"), """
cut as (select case when fp > 0.1 and cutoff > 0 then cutoff + 1 else cutoff end as cutoff from first_cut, fp)""",
             THRESHOLDS.replace("as p from alpha)", "as p0 from alpha),\nrated as (select p0 + fp - p0*fp as p from rate, fp)")
             .replace("unnest(range(1, 18)) as n)), rate)", "unnest(range(1, 18)) as n)), rated)"),
             COVERAGE, TRUSTED, *correction("reads", max_corrections=5)], result),
        "correction_accuracy": recursive([*PASS2, *correction("reads"), """
letters as (select substr(r.seq, i, 1) <> substr(r.true_seq, i, 1) as was_wrong, substr(c.seq, i, 1) <> substr(r.true_seq, i, 1) as is_wrong
  from (select *, cast(unnest(range(1, length(true_seq) + 1)) as int) as i from reads) r
    join corrected c on c.read_idx = r.read_idx where length(c.seq) = length(r.true_seq))"""], """
select count(*) filter (was_wrong) as n_errors, count(*) filter (was_wrong and not is_wrong) as n_mended,
  count(*) filter (is_wrong and not was_wrong) as n_made,
  round((count(*) filter (was_wrong and not is_wrong) - count(*) filter (is_wrong and not was_wrong))
    / nullif(count(*) filter (was_wrong), 0), 9) as gain from letters"""),
        "correct_noisy_reads": recursive([*noisy, *correction("noisy")], result),
        "correct_noisy_reads_joined": recursive([*noisy, *correction("noisy")], result),
        "correct_reads_trim": recursive([*noisy, *correction("noisy", trim=True, new_quality="5")], result),
        "correct_reads_strict": recursive([*noisy, *correction("noisy", max_corrections=2)], result),
        "annotated_headers": recursive([*noisy, *correction("noisy")], """
select c.file_ind, c.read_idx, case when correction = 0 and bad_prefix = 0 and bad_suffix = 0 then id
  else concat(id, case when correction > 0 then ' cor' else '' end,
    case when bad_prefix > 0 then concat(' bad_prefix=', cast(bad_prefix as varchar)) else '' end,
    case when bad_suffix > 0 then concat(' bad_suffix=', cast(bad_suffix as varchar)) else '' end,
    case info when 1 then ' oc' when 2 then ' ak' when 3 then ' lc' else '' end) end as id
from corrected c join noisy n on n.file_ind = c.file_ind and n.read_idx = c.read_idx where correction >= 0"""),
        "correction_summary": recursive([*noisy, *correction("noisy", trim=True), """
totals as (select coalesce(sum(correction) filter (correction > 0), 0) as corr_cnt,
  count(*) filter (bad_suffix > 0) as trim_reads_cnt, coalesce(sum(bad_suffix) filter (bad_suffix > 0), 0) as trim_base_cnt,
  count(*) filter (correction < 0) as discard_reads_cnt, count(*) as total_reads,
  count(*) filter (correction = 0) as error_free_reads_cnt from corrected)"""], """
select cast(corr_cnt as bigint) as corr_cnt, trim_reads_cnt, cast(trim_base_cnt as bigint) as trim_base_cnt,
  discard_reads_cnt, total_reads, error_free_reads_cnt,
  round(coalesce(corr_cnt / nullif(total_reads - error_free_reads_cnt, 0), 0.0), 9) as corrections_per_read,
  round(coalesce(trim_base_cnt / nullif(trim_reads_cnt, 0), 0.0), 9) as bases_per_trim from totals"""),
    })
    return out
