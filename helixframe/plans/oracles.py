"""The registered queries again, in plain SQL for a second engine. Written from the definitions, not from the DataFrame code:
windows are sliding frames, intervals are merged by self-containment, tables are unrolled."""

from __future__ import annotations

from helixframe.plans.queries import BINNED, SECRET, STEP, P

M32 = 1 << 32
_LETTERS = "translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGTACGTACGTACGTNCGTACGNAN')"
_X = "('0x' || substr(sha1(kmer), 1, 8))::bigint"


def cut(source: str, keys: str, k: int) -> str:
    return f"(select {keys}, pos, substr(seq, (pos + 1)::bigint, {k}) as kmer from (select {keys}, seq, unnest(range(0, length(seq) - {k} + 1)) as pos from {source}) q0) q1"


def clean(source: str, keys: str, k: int) -> str:
    return f"(select * from {cut(source, keys, k)} where kmer not like '%N%') q2"


BASE = f"""
with refs as (select doc_id as seq_id, {_LETTERS} as seq from documents where text is not null),
reads as (select item_id as rid, {_LETTERS} as seq from benchmark where text is not null),
strands as (select rid, 0 as rc, seq from reads union all select rid, 1, reverse(translate(seq, 'ACGT', 'TGCA')) from reads),
hist as (select kmer, count(*) as cnt from {clean('refs', 'seq_id', P.k)} group by kmer having count(*) > 1)
"""
_MIN = ", ".join(f"min(({a} * x) % {M32}) as m{j}" for j, a in enumerate(P.minhash_coefficients()))
SKETCH = f""",
frequent as (select kmer from hist where cnt >= {P.max_count}),
sketches as (select rid, rc, count(*) as n_valid, {_MIN} from (select rid, rc, {_X} as x from {clean('strands', 'rid, rc', P.k)} where kmer not in (select kmer from frequent)) t group by rid, rc having count(*) > {2 * P.k})
"""
_SLIDE = ", ".join(f"min(({a} * x) % {M32}) over f as m{j}" for j, a in enumerate(P.minhash_coefficients()))
ROLL = f""",
hashed as (select seq_id, pos, case when kmer not like '%N%' and kmer not in (select kmer from frequent) then {_X} end as x, count(*) over (partition by seq_id) as total from {cut('refs', 'seq_id', P.k)}),
rolling as (select seq_id, pos, {", ".join(f"m{j}" for j in range(P.h))} from (select seq_id, pos, total, {_SLIDE} from hashed window f as (partition by seq_id order by pos rows between current row and {P.w - P.k} following)) t where pos + {P.w - P.k} < total and m0 is not null),
letters as (select seq_id, pos, count(*) over (partition by seq_id) as total, {", ".join(f"sum((kmer = '{b}')::int) over f as n{b}" for b in "ACGTN")} from {cut('refs', 'seq_id', 1)} window f as (partition by seq_id order by pos rows between current row and {P.w - 1} following)),
windows as (select seq_id, pos from letters where pos + {P.w - 1} < total and nN <= {P.w // 50} and (nA = 0)::int + (nC = 0)::int + (nG = 0)::int + (nT = 0)::int <= 1 and (nA < 5)::int + (nC < 5)::int + (nG < 5)::int + (nT < 5)::int <= 1)
"""


def tables(source: str, keys: str) -> str:
    """One select a table; hash of the table's coordinates, low 32 bits."""
    c = P.projection_coefficients()
    parts = []
    for t, idx in enumerate(P.projections()):
        total = " + ".join(f"{a}::hugeint * m{i}" for a, i in zip(c, idx, strict=True))
        parts.append(f"select {keys}, {t} as tbl, (({total}) % {M32})::bigint as proj from {source}")
    return f"(select *, (proj >> {32 - P.buckets_pow2})::int as bucket from ({' union all '.join(parts)}) u)"


def index(by: str) -> str:
    return f"""(select tbl, arg_min(bucket, pos) as bucket, arg_min(proj, pos) as proj, seq_id, min(pos) as pos, count(*) as len from (
        select *, sum(fresh) over (partition by seq_id, tbl order by pos) as run from (
        select *, case when lag({by}) over (partition by seq_id, tbl order by pos) = {by} and lag(pos) over (partition by seq_id, tbl order by pos) = pos - 1 then 0 else 1 end as fresh
        from {tables('(select r.* from rolling r semi join windows w on r.seq_id = w.seq_id and r.pos = w.pos)', 'seq_id, pos')}) a) b group by seq_id, tbl, run)"""


INDEX = f""",
idx as materialized (select * from {index('proj')}),
probed as materialized (select a.rid, a.rc, i.tbl, i.seq_id, i.pos, i.len from {tables('sketches', 'rid, rc')} a join idx i on a.tbl = i.tbl and a.proj = i.proj
    where (select count(*) from idx z where z.tbl = i.tbl and z.bucket = i.bucket) <= {P.bucket_cap}),
heads as (select distinct rid, rc, seq_id, pos from probed p where not exists (select 1 from probed o where o.rid = p.rid and o.rc = p.rc and o.seq_id = p.seq_id and o.pos < p.pos and o.pos + o.len - 1 >= p.pos)),
placed as (select p.*, (select max(h.pos) from heads h where h.rid = p.rid and h.rc = p.rc and h.seq_id = p.seq_id and h.pos <= p.pos) as head from probed p),
islands as (select rid, rc, seq_id, head + 1 as start, max(pos + len - 1) - head as len, count(distinct tbl) as hits from placed group by rid, rc, seq_id, head),
contigs as materialized (select i.rid, i.rc, i.seq_id, greatest(i.start - 50, 0) as start, i.len + 100 + length(r.seq) as len, i.hits from islands i join reads r on i.rid = r.rid
    where i.len <= {P.contig_cap} and i.hits >= {P.min_hits} and i.hits >= (select max(o.hits) from islands o where o.rid = i.rid and o.len <= {P.contig_cap} and o.hits >= {P.min_hits}) - {P.best_dist}),
own as (select rid, rc, kmer, min(pos) as rpos from {clean('strands', 'rid, rc', P.k2)} group by rid, rc, kmer having count(*) = 1),
theirs as (select c.rid, c.rc, c.seq_id, c.start, k.kmer, min(k.pos - c.start) as cpos from contigs c join (select * from {clean('(select * from refs where seq_id in (select seq_id from contigs))', 'seq_id', P.k2)}) k on k.seq_id = c.seq_id and k.pos between c.start and c.start + greatest(c.len - {P.k2}, 0)
    group by c.rid, c.rc, c.seq_id, c.start, k.kmer having count(*) = 1),
matches as materialized (select t.rid, t.rc, t.seq_id, t.start, o.rpos, t.cpos from theirs t join own o on t.rid = o.rid and t.rc = o.rc and t.kmer = o.kmer),
sized as (select m.*, length(s.seq) - {P.k2 - 1} as nr, c.len - {P.k2 - 1} as nc from matches m join contigs c using (rid, rc, seq_id, start) join strands s using (rid, rc))
"""


def votes(b: int) -> str:
    low, high = f"(cpos // {b}) * {b} - least((rpos // {b} + 1) * {b}, nr)", f"least((cpos // {b} + 1) * {b}, nc) - (rpos // {b}) * {b}"
    return f"(select rid, rc, seq_id, start, nr, nc, diag, count(*) as votes from (select *, unnest(range({low}, {high})) as diag from sized) t group by all)"


CONVOLVED = f"""(select a.rid, a.rc, a.seq_id, a.start, a.nr, a.nc, a."at", sum(v.votes)::bigint as score from
    (select rid, rc, seq_id, start, nr, nc, unnest(range(-nr, nc)) as "at" from (select distinct rid, rc, seq_id, start, nr, nc from sized) t) a
    join {votes(1)} v on v.rid = a.rid and v.rc = a.rc and v.seq_id = a.seq_id and v.start = a.start and v.diag between a."at" - {P.delta} and a."at" + {P.delta} and not (v.diag = -a.nr and a."at" <= -a.nr + {P.delta}) group by all)"""
_KEY = lambda i: f"sha1('{SECRET}:{i}:' || rid || ':' || rc)"
_WORD = lambda digest: f"('0x' || substr({digest}, 1, 16))::ubigint"
CIPHER = f"""(select rid, rc, pos, case when n = 1 then upper(format('{{:016x}}', ((xor({_WORD('sha1(kmer)')}, {_WORD(_KEY(1))})::uhugeint * ({_WORD(_KEY(2))} | 1)::uhugeint) % 18446744073709551616::uhugeint)::ubigint)) end as cipher
    from (select rid, rc, pos, kmer, plain.n from {clean('strands', 'rid, rc', P.k2)} join (select rid, rc, pos, count(*) over (partition by rid, rc, translate(kmer, 'N', 'A')) as n from {cut('strands', 'rid, rc', P.k2)}) plain using (rid, rc, pos)) t)"""
REPEAT = f"(select rid, rc, pos, count(*) over (partition by rid, rc, translate(kmer, 'N', 'A')) > 1 as masked from {cut('strands', 'rid, rc', 6)})"
NEXT = lambda k: f"(select seq_id, pos, case when d <= 65535 then d else 0 end as next_dist from (select seq_id, pos, lead(pos) over (partition by seq_id, kmer order by pos) - pos as d from {clean('refs', 'seq_id', k)}) t)"
WINDOW_COUNTS = f"(select seq_id, win, kmer, count(*) as cnt from {clean('refs', 'seq_id', 8)} join (select unnest(range(0, 200000, {STEP})) as win) w on q2.pos between win and win + {P.w - 8} group by all)"
_I, _B = BINNED.interval, BINNED.bin_size

PARTS: dict[str, tuple[str, str]] = {
    "seq_encode": (BASE, f"select seq_id, seq, greatest(length(seq) - {P.k - 1}, 0) as n from refs"),
    "seq_revcomp": (BASE, "select rid, seq from strands where rc = 1"),
    "kmer_explode": (BASE, f"select seq_id, count(*) as n, sum(pos)::bigint as sum_pos, min(kmer) as least from {clean('refs', 'seq_id', P.k)} group by seq_id"),
    "kmer_pack": (BASE, f"select rid, rc, pos, case when kmer not like '%N%' then list_reduce([instr('AGCT', c) - 1 for c in string_split(kmer, '')], lambda a, b: a * 4 + b)::bigint end as code, case when kmer not like '%N%' then kmer end as kmer from {cut('strands', 'rid, rc', P.k)}"),
    "kmer_histogram": (BASE, "select * from hist"),
    "kmer_histogram_32": (BASE, f"select kmer, count(*) as cnt from {clean('refs', 'seq_id', 32)} group by kmer having count(*) > 1"),
    "count_of_counts": (BASE, "select b.cnt, count(h.cnt) as n from (select unnest(range(0, (select max(least(cnt, 999999)) from hist) + 1)) as cnt) b left join (select least(cnt, 999999) as cnt from hist) h on b.cnt = h.cnt group by b.cnt"),
    "frequent_kmer_filter": (BASE, f"select seq_id, count(*) as n from {clean('refs', 'seq_id', P.k)} where kmer not in (select kmer from hist where cnt >= 8) group by seq_id"),
    "informative_windows": (BASE + SKETCH + ROLL, "select seq_id, count(*) as n, sum(pos)::bigint as sum_pos from windows group by seq_id"),
    "read_minhash": (BASE + SKETCH, "select * from sketches"),
    "minhash_rolling": (BASE + SKETCH + ROLL, "select * from rolling"),
    "minhash_projection": (BASE + SKETCH, f"select * from {tables('sketches', 'rid, rc')}"),
    "lsh_index": (BASE + SKETCH + ROLL, f"select * from {index('proj')}"),
    "lsh_index_by_bucket": (BASE + SKETCH + ROLL, f"select * from {index('bucket')}"),
    "lsh_bucket_stats": (BASE + SKETCH + ROLL, f"select tbl, bucket, count(*) as size, (sum(len) // count(*))::bigint as avg_len from {index('proj')} group by tbl, bucket"),
    "lsh_probe": (BASE + SKETCH + ROLL + INDEX, "select * from probed"),
    "contig_islands": (BASE + SKETCH + ROLL + INDEX, "select * from islands"),
    "contig_filter": (BASE + SKETCH + ROLL + INDEX, f"select *, not (hits < 2 and count(*) over (partition by rid) > {P.contigs_threshold}) as valid from contigs"),
    "next_occurrence": (BASE, f"select * from {NEXT(P.k2)}"),
    "repeat_mask": (BASE, f"select * from {REPEAT}"),
    "keyed_ciphers": (BASE, f"select * from {CIPHER}"),
    "sampled_kmers": (BASE, f"select seq_id, n, n // {_I} as uniform, (ceil(n / {_B}) - 1)::bigint * ({_B} // {_I}) + (n - (ceil(n / {_B}) - 1)::bigint * {_B}) // {_I} as binned from (select seq_id, length(seq) - {P.k2 - 1} as n from refs) t where n > 0"),
    "unique_matches": (BASE + SKETCH + ROLL + INDEX, "select * from matches"),
    "vote_diagonals": (BASE + SKETCH + ROLL + INDEX, "select rid, rc, seq_id, start, cpos - rpos as diag, count(*) as votes from matches group by all"),
    "vote_discretised": (BASE + SKETCH + ROLL + INDEX, f"select * from {votes(1)}"),
    "vote_discretised_binned": (BASE + SKETCH + ROLL + INDEX, f"select * from {votes(_B)}"),
    "vote_convolution": (BASE + SKETCH + ROLL + INDEX, f"select * from {CONVOLVED}"),
    "rname_lookup": (BASE, "select rid, \"at\", seq_id, o as \"offset\" from (select rid, rid * 997 as \"at\" from reads) p join (select seq_id, length(seq) as len, sum(length(seq)) over (order by seq_id)::bigint - length(seq) as o from refs) s on p.\"at\" between o and o + len - 1"),
    "communication_size": (BASE, f"select count(*) as n_tasks, sum(8 * n)::bigint as n_bytes from (select rid, rc, count(*) as n from {CIPHER} where cipher is not null group by rid, rc) t"),
    "window_repeats": (BASE, f"select seq_id, win, max(cnt) as most, count(*) filter (cnt > 1) as repeated from {WINDOW_COUNTS} group by seq_id, win"),
    "repeat_fingerprints": (BASE, f"select fingerprint, count(*) as n from (select seq_id, win, coalesce(string_agg(cnt::varchar, ' ' order by cnt) filter (cnt > 1), '') as fingerprint from {WINDOW_COUNTS} group by seq_id, win) t group by fingerprint"),
    "repeat_bins": (BASE, f"select seq_id, pos // {P.k2} as bin, count(*) as n from {NEXT(P.k2)} where next_dist > 0 group by all having count(*) > {P.k2 // P.interval // 2}"),
    "chain_fragments": (BASE + SKETCH + ROLL + INDEX, f"select rid, rc, seq_id, start, min(rpos) as rpos, min(cpos) as cpos, count(*) + {P.k2 - 1} as n from (select *, sum(fresh) over (partition by rid, rc, seq_id, start, cpos - rpos order by rpos) as run from (select *, case when lag(rpos) over (partition by rid, rc, seq_id, start, cpos - rpos order by rpos) = rpos - 1 then 0 else 1 end as fresh from matches) a) b group by rid, rc, seq_id, start, cpos - rpos, run"),
}
SQL = {name: head + body for name, (head, body) in PARTS.items()}
