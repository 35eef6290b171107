"""The corrector in SQL: a recursive query that moves all lanes one base at a time.

Used only to check results with another engine. ``once`` corrects the rows of a
table ``(piece, seq, qual)``; a whole correction runs it on the reads and again on
their long uncorrected ends.
"""

from __future__ import annotations

from mendseq.plans.workspace import DEFAULT_K

K = DEFAULT_K
CAP_WINDOW = 20

# Trusted k-mers in both orientations, and how far the preferred base after each
# (k-1)-mer leads on: A first going right; T first on the mirrored strand.
MEMBERS = f"""
bb as materialized (select kmer as km from b_set union select reverse(translate(kmer, 'ACGT', 'TGCA')) from b_set),
onward as materialized (
  select 0 as side, left(km, {K - 1}) as tail, concat(substr(left(km, {K - 1}), 2), min(right(km, 1))) as next_tail
  from bb group by left(km, {K - 1})
  union all
  select 1, left(km, {K - 1}), concat(substr(left(km, {K - 1}), 2), max(right(km, 1))) from bb group by left(km, {K - 1})),
walk as (
  select side, tail as origin, next_tail as here, 1 as depth from onward
  union all
  select w.side, w.origin, o.next_tail, w.depth + 1 from walk w join onward o on o.side = w.side and o.tail = w.here
  where w.depth < {K - 1}),
deep as materialized (select side, origin as tail, max(depth) as depth from walk group by side, origin)"""


def _flags(p: str, name: str, text: str, source: str) -> str:
    return f"""
{p}{name} as materialized (select piece, len, pos, case when bb.km is not null then 1 else 0 end as solid
  from (select piece, length({text}) as len, {text} as t,
          unnest(range(0, greatest(length({text}) - {K} + 1, 0))) as pos from {source})
    left join bb on bb.km = substr(t, cast(pos + 1 as int), {K}))"""


def _runs(p: str, name: str, source: str) -> str:
    return f"""
{p}{name} as materialized (select piece, min(pos) as start, count(*) as size from (
    select piece, pos, pos - row_number() over (partition by piece order by pos) as island
    from {source} where solid = 1) group by piece, island)"""


def _anchors(p: str, source: str) -> str:
    """The best single change of each piece without a trusted k-mer."""
    return f"""
{p}lost as (select s.* from {source} s where length(seq) >= {K} and not exists (
  select 1 from {p}raw f where f.piece = s.piece and f.solid = 1)),
{p}changes as (select piece, qual, length(seq) as len, pos, base,
    concat(substr(seq, 1, cast(pos as int)), base, substr(seq, cast(pos + 2 as int))) as changed
  from (select *, unnest(['A', 'C', 'G', 'T']) as base
    from (select piece, seq, qual, unnest(range(0, length(seq))) as pos from {p}lost))
  where base <> substr(seq, cast(pos + 1 as int), 1)),
{p}found as (select c.*, case when bb.km is not null then 1 else 0 end as hit
  from (select *, unnest(range(greatest(pos - {K - 1}, 0), least(pos, len - {K}) + 1)) as start from {p}changes) c
    left join bb on bb.km = substr(changed, cast(start + 1 as int), {K})),
{p}promising as (select piece, pos, base from {p}found where hit = 1
  and start = least(greatest(pos - {K // 2} + 1, 0), len - {K})),
{p}scored as (select piece, pos, base, any_value(qual) as qual, max(n) as run from (
    select piece, pos, base, any_value(qual) as qual, count(*) as n from (
      select f.*, start - row_number() over (partition by f.piece, f.pos, f.base order by start) as island
      from {p}found f join {p}promising using (piece, pos, base) where hit = 1)
    group by piece, pos, base, island) group by piece, pos, base),
{p}anchor as materialized (select piece, pos, base from {p}scored qualify row_number() over (
  partition by piece order by run desc, ascii(substr(qual, cast(pos + 1 as int), 1)), pos, base) = 1)"""


def _put(text: str, spot: str, letter: str) -> str:
    return f"concat(substr({text}, 1, cast({spot} as int)), {letter}, substr({text}, cast({spot} + 2 as int)))"


def _window(text: str, spot: str, letter: str, w: str) -> str:
    return f"substr({_put(text, spot, letter)}, cast({spot} - {K} + 2 + {w} as int), {K})"


def _lanes(p: str) -> str:
    other = f"(select *, unnest(['A', 'C', 'G', 'T']) as base from {p}lane)"
    return f"""
{p}best as (select piece, start, size from {p}runs
  qualify row_number() over (partition by piece order by size desc, start) = 1),
{p}state as (select t.piece, t.txt, length(t.txt) as len, length(t.txt) - {K} + 1 as n_windows, start, size, flags
  from {p}text t join {p}best using (piece)
    join (select piece, string_agg(cast(solid as varchar), '' order by pos) as flags from {p}fix0 group by piece) using (piece)
  where size < length(t.txt) - {K} + 1),
{p}lane as materialized (
  select piece*2 as lane, 0 as side, len, txt as text, flags, start + size as gap, size as run from {p}state
  where start + size < n_windows
  union all
  select piece*2 + 1, 1, len, reverse(translate(txt, 'ACGT', 'TGCA')), reverse(flags), n_windows - start, size
  from {p}state where start > 0),
{p}checked as (select lane, base, any_value(len - gap - {K} + 1) as ahead, count(bb.km) as hits from (
    select *, unnest(range(0, least({K}, len - gap - {K}) + 1)) as w from {other}
    where run >= {K} and base <> substr(text, cast(gap + {K} as int), 1)) c
  left join bb on bb.km = {_window('text', f'(gap + {K - 1})', 'base', 'w')} group by lane, base),
{p}good as (select distinct lane from {p}checked where hits = 1 + least({K}, ahead - 1)),
{p}moved as (select lane, j, base, count(bb.km) as hits, count(bb.km) filter (w = 0) as first_hit from (
    select *, unnest(range(0, {K // 2 + 2})) as w from (
      select *, unnest(range(0, {K // 2})) as j from {other}
      where run >= {K} and lane not in (select lane from {p}good))
    where base <> substr(text, cast(gap + {K} - 1 - j as int), 1)) m
  left join bb on bb.km = {_window('text', f'(gap + {K - 2} - j)', 'base', 'w')} group by lane, j, base),
{p}shift as (select lane, max(case when hits = {K // 2 + 2} then j end) as j, max(first_hit) > 0 as ways
  from {p}moved group by lane),
{p}begin as materialized (select l.lane, side, len, gap + {K - 1} - coalesce(j + 1, 0) as spot, text, flags,
    repeat('.', cast(len as int)) as fixes, coalesce(ways, false) as ways, false as several, 0 as outcome
  from {p}lane l left join {p}shift s on s.lane = l.lane),
{p}scan as (
  select * from {p}begin
  union all
  select lane, side, len,
    case when stops then spot when jump then spot + gap_after + {K - 1} else top end,
    case when stops or tied then text else {_put('text', 'spot', 'pick')} end, flags,
    case when stops then fixes else {_put('fixes', 'spot', "case when tied then '?' else pick end")} end,
    ways or n_found > 1, several or (tied and not stops),
    case when top is null then 3 when stops then 2 when top >= len or (jump and gap_after = 0) then 1 else 0 end
  from (select *, top is null or (tied and (top <= last or len - spot < {K})) as stops, top > last as jump
    from (select *, case when keeps then own when ra = top then 'A' when rc = top then 'C' when rg = top then 'G' else 'T' end as pick,
        not keeps and n_top > 1 as tied
      from (select *, coalesce(top = spot + 1 and own_reach = top, false) as keeps
        from (select *, least(spot + {K} - 1, len - 1) as last, strpos(substr(flags, cast(spot + 2 as int)), '0') as gap_after,
            case own when 'A' then ra when 'C' then rc when 'G' then rg when 'T' then rt end as own_reach,
            (case when ra = top then 1 else 0 end) + (case when rc = top then 1 else 0 end)
              + (case when rg = top then 1 else 0 end) + (case when rt = top then 1 else 0 end) as n_top
          from (select lane, any_value(side) as side, any_value(len) as len, any_value(spot) as spot, any_value(text) as text,
              any_value(flags) as flags, any_value(fixes) as fixes, any_value(ways) as ways, any_value(several) as several,
              any_value(substr(text, cast(spot + 1 as int), 1)) as own, max(reach) as top, count(reach) as n_found,
              max(case when base = 'A' then reach end) as ra, max(case when base = 'C' then reach end) as rc,
              max(case when base = 'G' then reach end) as rg, max(case when base = 'T' then reach end) as rt
            from (select m.*, case when hits > 0 then spot + hits + case when spot + hits = len and len - spot < {K}
                  then least({K} - (len - spot), coalesce(depth, 0)) else 0 end end as reach
              from (select *, bit_count(xor(mask, mask + 1) >> 1) as hits,
                  right({_put('text', 'spot', 'base')}, {K - 1}) as tail
                from (select lane, base, any_value(side) as side, any_value(len) as len, any_value(spot) as spot,
                    any_value(text) as text, any_value(flags) as flags, any_value(fixes) as fixes,
                    any_value(ways) as ways, any_value(several) as several,
                    cast(coalesce(sum(case when bb.km is not null then cast(1 as bigint) << w end), 0) as bigint) as mask
                  from (select *, cast(unnest(range(0, least({K}, len - spot))) as bigint) as w
                    from (select *, unnest(['A', 'C', 'G', 'T']) as base from {p}scan where outcome = 0)) c
                  left join bb on bb.km = {_window('text', 'spot', 'base', 'w')}
                  group by lane, base)) m
              left join deep d on d.side = m.side and d.tail = m.tail)
            group by lane)))))),
{p}end as materialized (select lane // 2 as piece, * from {p}scan where outcome > 0)"""


def _finish(p: str, source: str, max_corrections: int, new_quality: str | None) -> str:
    quality = f"case when fixed then '{new_quality}' else q end" if new_quality else "q"
    return f"""
{p}fx as (
  select piece, case when side = 0 then pos else len - 1 - pos end as pos,
    case when side = 0 then base else translate(base, 'ACGT', 'TGCA') end as base
  from (select piece, side, len, pos, substr(fixes, cast(pos + 1 as int), 1) as base
    from (select *, unnest(range(0, len)) as pos from {p}end)) where base <> '.'
  union all
  select piece, pos, base from {p}anchor),
{p}spans as (select piece, start, start + size + {K - 1} as stop from {p}rawruns join {source} using (piece)
  where start + size < length(seq) - {K} + 1),
{p}touched as (select distinct f.piece from {p}fx f join {p}spans s on s.piece = f.piece and f.pos >= s.start and f.pos < s.stop),
{p}ends as (select piece, any_value(len) as len,
    coalesce(max(case when side = 1 and outcome > 1 then len - spot end), 0) as bp,
    coalesce(max(case when side = 0 and outcome > 1 then spot end), any_value(len)) as stop,
    max(case when outcome > 1 then 2 else 0 end) as info, bool_or(outcome = 3) as nothing,
    bool_or(several) as several, bool_or(ways) or piece in (select piece from {p}anchor) as ways
  from {p}end group by piece),
{p}cells as (select e.*, c.pos, letter, q, base, base in ('A', 'C', 'G', 'T') as is_fix,
    case when base in ('A', 'C', 'G', 'T') and letter <> 'N'
      then case when ascii(q) <= (select cutoff from cut) then 1 else 2 end else 0 end as weight,
    case when not ways and e.piece not in (select piece from {p}touched)
      and c.pos >= {CAP_WINDOW} and c.pos + {CAP_WINDOW - 1} < len then 2 else 0 end as bonus
  from {p}ends e join (select piece, pos, substr(seq, cast(pos + 1 as int), 1) as letter, substr(qual, cast(pos + 1 as int), 1) as q
      from (select *, unnest(range(0, length(seq))) as pos from {source})) c on c.piece = e.piece
    left join {p}fx f on f.piece = c.piece and f.pos = c.pos),
{p}capped as (select *, coalesce(is_fix, false) and sum(weight) over (partition by piece order by pos
    rows between {CAP_WINDOW - 1} preceding and current row) > {2 * max_corrections} + bonus as over from {p}cells),
{p}linked as (select piece, pos, over, sum(case when pos - before < {K} then 0 else 1 end) over (partition by piece order by pos) as chain
  from (select *, lag(pos) over (partition by piece order by pos) as before from {p}capped where is_fix)),
{p}undone as (select piece, pos, bool_or(over) over (partition by piece, chain) as undo from {p}linked),
{p}applied as (select c.*, coalesce(is_fix and not undo and c.pos >= bp and c.pos < stop and letter <> base, false) as fixed
  from {p}capped c left join {p}undone u on u.piece = c.piece and u.pos = c.pos),
{p}done as (select piece, string_agg(case when fixed then base else letter end, '' order by pos) as seq,
    string_agg({quality}, '' order by pos) as qual, count(*) filter (fixed) as n, any_value(bp) as bp,
    any_value(len - stop) as bs, any_value(info) as info, any_value(nothing) as nothing,
    any_value(several) as several, bool_or(over) as over from {p}applied group by piece),
{p}out as materialized (
  select s.piece, coalesce(d.seq, s.seq) as seq, coalesce(d.qual, s.qual) as qual,
    case when d.piece is not null then case when n = 0 and bp = 0 and bs = 0 and (several or over) then -1 else n end
      when l.piece is not null and a.piece is null then -1 else 0 end as correction,
    coalesce(bp, 0) as bp, coalesce(bs, 0) as bs,
    case when d.piece is not null then case when nothing then 3 when n = 0 and bp = 0 and bs = 0 and several then 2
        when n = 0 and bp = 0 and bs = 0 and over then 1 else info end
      when l.piece is not null and a.piece is null then 3 else 0 end as info
  from {source} s left join {p}done d on d.piece = s.piece left join {p}lost l on l.piece = s.piece
    left join {p}anchor a on a.piece = s.piece)"""


def once(p: str, source: str, max_corrections: int, new_quality: str | None) -> list[str]:
    return [
        _flags(p, "raw", "seq", source), _runs(p, "rawruns", f"{p}raw"), _anchors(p, source),
        f"""
{p}text as (select s.piece, case when a.piece is null then seq else {_put('seq', 'a.pos', 'a.base')} end as txt
  from {source} s left join {p}anchor a on a.piece = s.piece)""",
        _flags(p, "fix0", "txt", f"{p}text"), _runs(p, "runs", f"{p}fix0"), _lanes(p),
        _finish(p, source, max_corrections, new_quality)]


def correction(source: str, max_corrections: int = 4, trim: bool = False,
               new_quality: str | None = None) -> list[str]:
    """CTEs ending in ``corrected``: the result of correcting the reads of ``source``."""
    long_end = f"least(length(seq) // 2, {2 * K})"
    cut = "greatest(length(seq) - case when correction >= 0 then bad_suffix else 0 end, 0)" if trim else "length(seq)"
    return [
        MEMBERS, f"\nmain as (select read_idx as piece, seq, qual from {source})",
        *once("m_", "main", max_corrections, new_quality),
        f"""
again as materialized (
  select piece*2 as piece, substr(seq, 1, cast(bp as int)) as seq, substr(qual, 1, cast(bp as int)) as qual
  from m_out where correction >= 0 and bp > {long_end}
  union all
  select piece*2 + 1, right(seq, cast(bs as int)), right(qual, cast(bs as int))
  from m_out where correction >= 0 and bs > {long_end})""",
        *once("s_", "again", max_corrections, new_quality),
        """
joined as (
  select m.piece, m.info as m_info, m.bp, m.bs, m.correction as m_correction, length(m.seq) as len,
    l.correction >= 0 as l_ok, l.correction as l_n, l.bp as l_bp, l.bs as l_bs, coalesce(l.info, 0) as l_info,
    r.correction >= 0 as r_ok, r.correction as r_n, r.bp as r_bp, r.bs as r_bs, coalesce(r.info, 0) as r_info,
    concat(case when l.correction >= 0 then l.seq else substr(m.seq, 1, cast(m.bp as int)) end,
      substr(m.seq, cast(m.bp + 1 as int), cast(length(m.seq) - m.bp - m.bs as int)),
      case when r.correction >= 0 then r.seq else right(m.seq, cast(m.bs as int)) end) as seq,
    concat(case when l.correction >= 0 then l.qual else substr(m.qual, 1, cast(m.bp as int)) end,
      substr(m.qual, cast(m.bp + 1 as int), cast(length(m.seq) - m.bp - m.bs as int)),
      case when r.correction >= 0 then r.qual else right(m.qual, cast(m.bs as int)) end) as qual
  from m_out m left join s_out l on l.piece = m.piece*2 left join s_out r on r.piece = m.piece*2 + 1),
total as (select *, greatest(m_info, l_info, r_info) as info,
    m_correction + case when l_ok then l_n else 0 end + case when r_ok then r_n else 0 end as n,
    case when l_ok then l_bs else 0 end + case when r_ok then r_bp else 0 end as left_over from joined),
settled as (select piece, seq, qual, info, m_correction = -1 or (n = 0 and left_over > 0) as unfixable, n,
    case when l_ok then l_bp else bp end as bp, case when r_ok then r_bs else bs end as bs from total),
uncut as (select cast(0 as int) as file_ind, piece as read_idx, seq, qual, cast(case when unfixable then -1 else n end as int) as correction,
    cast(case when unfixable then 0 else bp end as int) as bad_prefix,
    cast(case when unfixable then 0 else bs end as int) as bad_suffix, cast(info as int) as info from settled)""",
        f"""
corrected as (select file_ind, read_idx, substr(seq, 1, cast({cut} as int)) as seq, substr(qual, 1, cast({cut} as int)) as qual,
    correction, bad_prefix, bad_suffix, info from uncut)"""]
