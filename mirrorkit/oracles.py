"""SQL twins of the registered queries, for checking results in another engine.

Each text is written from the rules, not from the Spark plans: a join here may be an aggregation there.
"""

from __future__ import annotations

from mirrorkit import fixtures as fx
from mirrorkit.fixtures import OLD_SPECS, SPECS
from mirrorkit.operators.routing import ROLE_ATTRS
from mirrorkit.spec import MirrorSpec


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _specs(specs: tuple[MirrorSpec, ...]) -> str:
    columns = (
        "mirror", "source_folder", "inbox", "dest_folder", "archive_on", "archive_folder", "sent_on", "sent_source",
        "sent_folder", "labels_on", "propagate", "label_exclude", "keyword_prefix", "keyword_replacement",
        "uid_batch", "dest_guard", "carry_seen", "poll_seconds", "allowed_tags",
    )

    def value(v) -> str:
        if v is None:
            return "cast(null as varchar)"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, int):
            return f"cast({v} as bigint)"
        if isinstance(v, tuple):
            return "cast([" + ", ".join(_text(x) for x in v) + "] as varchar[])"
        return _text(v)

    rows = [f"select {', '.join(f'{value(getattr(s, c))} as {c}' for c in columns)}" for s in specs]
    return "\nunion all ".join(rows)


def _slug(label: str, repl: str) -> str:
    return f"lower(trim(regexp_replace({label}, '[^A-Za-z0-9_-]+', {repl}, 'g'), {repl}))"


def _facts(members: str) -> str:
    return f"""select m.mirror, m.key, bool_or(m.folder = s.inbox) as in_inbox,
  bool_or(m.folder = s.sent_source) as in_sent,
  list_sort(list(distinct m.folder) filter (m.folder <> s.inbox and not (s.sent_on and m.folder = s.sent_source))) as labels
from {members} m join specs s using (mirror) group by m.mirror, m.key"""


def _placed(facts: str) -> str:
    return f"""select mirror, key,
  case when (archive_on or sent_on) and in_inbox then dest_folder when sent_on and in_sent then sent_folder
       when archive_on then archive_folder else dest_folder end as wanted,
  case when not labels_on or labels is null then cast([] as varchar[]) else
    list_transform(list_filter(list_transform(labels, lambda x: {_slug('x', 'keyword_replacement')}), lambda x: x <> ''),
      lambda x: concat(keyword_prefix, x)) end as tags
from (select k.mirror, k.key, coalesce(f.in_inbox, false) as in_inbox, coalesce(f.in_sent, false) as in_sent, f.labels
      from (select distinct mirror, key from keyed) k left join {facts} f using (mirror, key))
join specs using (mirror)"""


_KEY = """case when trim(message_id) <> '' then trim(message_id)
  else concat('synth-sha256:', sha256(concat(cast(floor(epoch(internal_date)) as bigint), '|',
    strlen(sender), ':', sender, '|', strlen(subject), ':', subject, '|', size))) end"""

# Views every query may build on, in dependency order.
CTES = {
    "msgs": """select concat('m', user_id % 4) as mirror, event_type as folder,
  cast(case when user_id % 4 = 2 then 2 else 1 end as bigint) as epoch, event_id + 1 as uid,
  case when event_id % 20 = 0 then ''
       else concat('  <u', user_id, '.', regexp_extract(props, '([0-9]+)', 1), '@ev> ') end as message_id,
  concat('user', user_id) as sender, concat('é ', event_type) as subject,
  ts as internal_date, cast(length(props) as bigint) as size, value
from events""",
    "keyed": f"select *, {_KEY} as key, trim(message_id) = '' as is_synth from msgs",
    "specs": _specs(SPECS),
    "old_specs": _specs(OLD_SPECS),
    "ledger": f"""select mirror, key, min(uid) as uid, min(cast(floor(epoch(internal_date)) as bigint)) as copied_at
from keyed where internal_date < '{fx.LEDGER_END}' group by mirror, key""",
    "members_old": f"select mirror, folder, key, is_synth, uid from keyed where internal_date < '{fx.OLD_END}'",
    "members_new": f"select mirror, folder, key, is_synth, uid from keyed where internal_date >= '{fx.NEW_START}'",
    "dest_keys": f"select distinct mirror, key from keyed where internal_date < '{fx.DEST_END}'",
    "copies": f"""select mirror, key, is_synth, cast(least as varchar) as copy_id,
  case least % 4 when 0 then 'Mirror' when 1 then 'Sent' when 2 then 'Archive' else 'Custom' end as folder,
  case when least % 2 = 0 then ['Click', 'mytag'] else cast([] as varchar[]) end as tags
from (select mirror, key, internal_date < '{fx.HALF}' as half, min(uid) as least, bool_or(is_synth) as is_synth
      from keyed group by mirror, key, internal_date < '{fx.HALF}')""",
    "folders": """select mirror, folder, list_filter(['\\HasNoChildren', role], lambda x: x is not null) as attrs, min(uid) as list_pos
from (select mirror, folder, uid, case when folder = 'purchase' then '\\Sent' end as role from msgs
      union all
      select mirror, concat('[Mail]/', folder), uid,
        case folder when 'view' then '\\All' when 'click' then '\\Trash' when 'error' then '\\Sent'
          when 'purchase' then '\\Important' end from msgs)
group by mirror, folder, role""",
    "change_log": """select mirror, folder, key, is_synth, uid, uid as seq, internal_date, value,
  case when value < 15 then 'remove' else 'add' end as op from keyed""",
    "queue": """select mirror, cast(dayofmonth(internal_date) as bigint) as batch_id, seq,
  case when folder in ('view', 'purchase') then 'move' else 'keyword' end as kind, key, folder, op, value
from change_log""",
    "bodies": """select mirror, epoch, uid, case when value < 2 then ''
  else concat('From: ', sender, chr(13), chr(10), 'Subject: ', subject, chr(13), chr(10), chr(13), chr(10), message_id)
  end as raw from msgs""",
    "marks": f"""select mirror, folder, cast(1 as bigint) as epoch, max(uid) as last_uid from msgs
where internal_date < '{fx.HALF}' group by mirror, folder""",
    "firsts": """select mirror, key, min(uid) as uid, count(*) as n_records, bool_or(is_synth) as is_synth
from keyed group by mirror, key""",
    "stored_even": """select mirror, folder, cast(1 as bigint) as epoch, max(uid) as last_uid from msgs where uid % 2 = 0
group by mirror, folder""",
    "scanned_odd": """select mirror, case when mirror = 'm3' then concat('[Mail]/', folder) else folder end as folder,
  max(epoch) as epoch, max(uid) as last_uid from msgs where uid % 2 = 1 group by 1, 2""",
    # Memberships as they stand, with what they mean under the mirror's rules.
    "facts": _facts("members_new"),
    "placed": _placed("facts"),
    "facts_all": _facts("keyed"),
    "placed_all": _placed("facts_all"),
    "buckets": """select mirror, dest_folder as folder, 1 as bucket_rank from specs
union all select mirror, sent_folder, 2 from specs where sent_on
union all select mirror, archive_folder, 3 from specs where archive_on""",
    "placements": "select c.*, b.bucket_rank from copies c join buckets b using (mirror, folder)",
    "by_key": """select coalesce(o.mirror, n.mirror) as mirror, coalesce(o.folder, n.folder) as folder,
  coalesce(o.key, n.key) as key, coalesce(n.uid, o.uid) as uid, coalesce(o.is_synth, n.is_synth) as is_synth,
  case when o.key is null then 'add' when n.key is null then 'remove' else 'same' end as op
from (select mirror, folder, key, max(uid) as uid, bool_or(is_synth) as is_synth from members_old group by all) o
full outer join (select mirror, folder, key, max(uid) as uid, bool_or(is_synth) as is_synth from members_new group by all) n
  on o.mirror = n.mirror and o.folder = n.folder and o.key = n.key""",
    "by_uid": """select mirror, folder, key, max(uid) as uid, bool_or(is_synth) as is_synth, 'remove' as op
from members_old o
group by mirror, folder, key
having not bool_or((mirror, folder, uid) in (select (mirror, folder, uid) from members_new))
union all
select n.mirror, n.folder, n.key, max(n.uid), bool_or(n.is_synth), 'add'
from members_new n left join (select mirror, folder, max(uid) as last_uid from members_old group by all) l using (mirror, folder)
where n.uid > coalesce(l.last_uid, 0) group by n.mirror, n.folder, n.key""",
    "role_attrs": "select unnest([" + ", ".join(_text(a) for a in ROLE_ATTRS) + "]) as attr",
    "label_list": """select f.* from folders f join specs s using (mirror)
where f.folder <> s.source_folder and lower(f.folder) <> 'inbox' and not list_contains(s.label_exclude, f.folder)
  and not exists (select 1 from (select unnest(f.attrs) as attr) a where a.attr in (select attr from role_attrs))""",
    "watch": """select l.mirror, l.folder, case when s.propagate then 'keyword' end as kind
from label_list l join specs s using (mirror)
where s.labels_on and l.folder <> s.inbox and not ((s.sent_on) and l.folder = s.sent_source)
union all select mirror, inbox, 'move' from specs where archive_on or sent_on
union all select mirror, sent_source, 'move' from specs where sent_on""",
    "copied": f"select distinct mirror, key from keyed where internal_date < '{fx.OLD_END}'",
    "ops": """select d.mirror, w.kind, d.key, d.folder, d.op, d.uid from by_key d join watch w using (mirror, folder)
where w.kind is not null and d.op <> 'same' and not d.is_synth
  and (d.mirror, d.key) in (select (mirror, key) from copied)
  and (d.mirror, d.folder) in (select (mirror, folder) from members_old)""",
    "move_wants": """select distinct o.mirror, o.key, p.wanted from ops o join placed p using (mirror, key) where o.kind = 'move'""",
    "located": """select w.mirror, w.key, w.wanted, min_by(p.folder, p.bucket_rank) as found
from move_wants w left join placements p on p.mirror = w.mirror and p.key = w.key and p.folder <> w.wanted
group by w.mirror, w.key, w.wanted""",
    "classified": """select f.*, case when l.key is not null then 'in_ledger'
  when d.key is not null and not f.is_synth and s.dest_guard then 'in_dest' else 'copy' end as status
from firsts f join specs s using (mirror)
left join ledger l on l.mirror = f.mirror and l.key = f.key
left join dest_keys d on d.mirror = f.mirror and d.key = f.key""",
    "plan": "select c.*, p.wanted, p.tags from classified c join placed p using (mirror, key)",
    "deltas_of": f"""select mirror, key, tag, arg_max(op, batch_id * 1000000000 + seq) as op
from (select q.*, concat(s.keyword_prefix, {_slug('q.folder', 's.keyword_replacement')}) as tag, s.allowed_tags
      from queue q join specs s using (mirror) where q.kind = 'keyword' and s.propagate)
where allowed_tags is null or regexp_matches(tag, allowed_tags)
group by mirror, key, tag""",
    "deltas": """select d.* from deltas_of d join placed p using (mirror, key)
where d.op = 'add' or not list_contains(list_transform(p.tags, lambda x: lower(x)), lower(d.tag))""",
    "tag_home": """select mirror, key, min_by(folder, bucket_rank) as folder from placements
where (mirror, key) in (select (mirror, key) from deltas) group by mirror, key""",
    "tag_rows": """select p.mirror, p.key, p.copy_id, d.tag, d.op
from placements p join tag_home h using (mirror, key, folder) join deltas d using (mirror, key)
where (d.op = 'add') <> list_contains(list_transform(p.tags, lambda x: lower(x)), lower(d.tag))""",
    "wants": """select p.mirror, p.key, p.wanted,
  list_filter(p.tags, lambda x: s.allowed_tags is null or regexp_matches(x, s.allowed_tags)) as tags
from placed p join specs s using (mirror)""",
    "repair": """select c.*, case when s.archive_on or s.sent_on then p.wanted else c.folder end as wanted,
  list_filter(p.tags, lambda x: not list_contains(list_transform(c.tags, lambda y: lower(y)), lower(x))) as missing
from placements c join wants p using (mirror, key) join specs s using (mirror)""",
    "audited": """select f.mirror, f.key, max(p.wanted) as wanted, max(f.n_records) as n_records, count(c.copy_id) as copies,
  case when count(c.copy_id) = 0 then 'missing' when count(c.copy_id) > 1 then 'duplicated'
       when not bool_or(c.folder = p.wanted) then 'misplaced'
       when max(len(list_filter(p.tags, lambda x: not list_contains(list_transform(c.tags, lambda y: lower(y)), lower(x))))) > 0
         then 'untagged' else 'ok' end as status
from firsts f join wants p using (mirror, key)
left join placements c on c.mirror = f.mirror and c.key = f.key
group by f.mirror, f.key""",
    "watched_old": "select m.* from members_old m join watch w using (mirror, folder)",
    "watched_new": "select m.* from members_new m join watch w using (mirror, folder)",
    "facts_old": _facts("watched_old"),
    "facts_new": _facts("watched_new"),
    "placed_old": _placed("facts_old"),
    "placed_new": _placed("facts_new"),
    "redo": f"""select d.mirror, d.folder, d.key, d.uid, d.is_synth, d.op from by_uid d where d.mirror <> 'm2'
union all select mirror, folder, key, uid, is_synth, op from by_key where mirror = 'm2' and op <> 'same'
  and (mirror, folder) in (select (mirror, folder) from members_old)""",
}


def _with(sql: str) -> str:
    """Put the views in front. Unused ones cost nothing."""
    return "with " + ",\n".join(f"{name} as ({text})" for name, text in CTES.items()) + "\n" + sql


_RAW = """concat('Message-ID:', chr(13), chr(10), ' <', conv_id, '.', turn, '@c>', chr(13), chr(10),
  'From: ', role, '@example.com', chr(13), chr(10), 'Subject: turn ', turn, chr(13), chr(10), chr(13), chr(10), text)"""
_LABEL = "concat('[', p_name, ']/', p_brand, ' Bü')"
_NUMBER = """case event_type when 'view' then regexp_extract(props, '([0-9]+)', 1) when 'click' then ''
  when 'signup' then concat('99999', event_id) else props end"""

_QUERIES = {
    "scan_uid_range": """select m.mirror, m.folder, m.epoch, m.uid, m.message_id, m.size
from msgs m left join marks k using (mirror, folder)
where k.epoch is null or k.epoch <> m.epoch or m.uid > k.last_uid""",
    "scan_messages": """select mirror, folder, epoch, uid, message_id, size from msgs, (select count(*) as n from events)
where mirror = 'm0' or (mirror = 'm1' and uid >= n // 3) or (mirror = 'm2' and uid <= n // 2)
  or (mirror = 'm3' and uid between n // 4 and n // 2)""",
    "sorted_files": "select mirror, folder, count(*) as n, cast(0 as bigint) as n_behind from msgs group by mirror, folder",
    "snapshot_uids": "select mirror, folder, uid from msgs",
    "parse_headers": f"""select conv_id, turn, concat('<', conv_id, '.', turn, '@c>') as message_id,
  concat(role, '@example.com') as sender, concat('turn ', turn) as subject, cast(strlen({_RAW}) as bigint) as size
from conversations""",
    "stream_multi_folder": """select mirror, key, uid, sender, raw from (
  select k.*, row_number() over (partition by k.mirror, k.key order by uid) as rn,
    concat('From: ', sender, chr(13), chr(10), 'Subject: ', subject, chr(13), chr(10), chr(13), chr(10), message_id) as raw
  from keyed k) where rn = 1""",
    "reconcile_missing_bodies": """select mirror, key, uid, raw from (
  select k.mirror, k.key, k.uid, row_number() over (partition by k.mirror, k.key order by k.value < 2, k.uid) as rn,
    concat('From: ', sender, chr(13), chr(10), 'Subject: ', subject, chr(13), chr(10), chr(13), chr(10), message_id) as raw
  from keyed k) where rn = 1""",
    "reconcile_windows": """select mirror, key, any_value(raw) as raw from (
  select mirror, key, concat('From: ', sender, chr(13), chr(10), 'Subject: ', subject, chr(13), chr(10), chr(13), chr(10), message_id) as raw
  from (select k.*, row_number() over (partition by k.mirror, k.key order by uid) as rn from keyed k where value >= 2) where rn = 1)
group by mirror, key""",
    "seed_modes": """select mirror, key, source from (
  select mirror, key, 'known' as source, 0 as rank from ledger where mirror <> 'm0'
  union all select mirror, key, 'seed', 1 from dest_keys where mirror in ('m0', 'm2')
  union all select mirror, key, 'guard', 2 from dest_keys d join (select mirror, key, bool_or(is_synth) as synth from keyed group by all)
    using (mirror, key) where mirror = 'm3' and not synth
  union all select distinct mirror, key, 'copy', 3 from keyed)
qualify row_number() over (partition by mirror, key order by rank) = 1""",
    "change_summary": """select s.mirror, coalesce(a.moved_to_archive, 0) as moved_to_archive,
  coalesce(a.moved_to_sent, 0) as moved_to_sent, coalesce(a.moved_to_inbox, 0) as moved_to_inbox,
  coalesce(t.tags_updated, 0) as tags_updated
from specs s left join (
  select l.mirror, count(*) filter (s.archive_on and l.wanted = s.archive_folder) as moved_to_archive,
    count(*) filter (not (s.archive_on and l.wanted = s.archive_folder) and s.sent_on and l.wanted = s.sent_folder) as moved_to_sent,
    count(*) filter (not (s.archive_on and l.wanted = s.archive_folder) and not (s.sent_on and l.wanted = s.sent_folder)) as moved_to_inbox
  from located l join specs s using (mirror) join placements p on p.mirror = l.mirror and p.key = l.key and p.folder = l.found
  where s.archive_on or s.sent_on group by l.mirror) a using (mirror)
left join (select mirror, count(distinct copy_id) as tags_updated from tag_rows group by mirror) t using (mirror)""",
    "attach_bodies": """select f.mirror, f.uid, f.key, b.raw from firsts f join bodies b using (mirror, uid)
where b.raw <> '' and not exists (select 1 from ledger l where l.mirror = f.mirror and l.key = f.key)""",
    "missing_bodies": """select f.mirror, 'All' as folder, b.epoch, f.uid, f.key
from firsts f join bodies b using (mirror, uid) where b.raw = ''""",
    "resolve_folders": """select s.mirror, r.role, case when r.role = 'view' then 'view'
  else coalesce((select min_by(f.folder, (f.list_pos, f.folder)) from folders f
                 where f.mirror = s.mirror and list_contains(f.attrs, r.role)), 'unresolved') end as folder
from specs s cross join (select unnest(['\\All', '\\Sent', '\\Trash', '\\Junk', 'view']) as role) r""",
    "folder_status": """select mirror, folder, epoch, max(uid) + 1 as uid_next, count(*) as n from msgs
group by mirror, folder, epoch""",
    "dest_bucket_scan": "select mirror, copy_id, key, folder, cast(bucket_rank as bigint) as bucket_rank from placements",
    "dedup_key": "select mirror, uid, key, is_synth from keyed",
    "document_keys": """select concat('synth-sha256:', sha256(concat('0|', strlen(source), ':', source, '|',
  strlen(text), ':', text, '|', n_chars))) as key, min(doc_id) as doc_id, count(*) as n_records
from documents group by 1""",
    "real_vs_synth": """select mirror, not starts_with(key, 'synth-sha256:') as is_real, count(*) as n from keyed
group by all""",
    "safe_flags": """select m.mirror, m.uid, case when s.carry_seen and m.value >= 10 then '\\Seen' else '' end as flags
from msgs m join specs s using (mirror)""",
    "keyword_slug": f"""select p_partkey, {_LABEL} as label, {_slug(_LABEL, "'_'")} as underscore,
  {_slug(_LABEL, "'-'")} as dash from part""",
    "keyword_prefix": f"""select doc_id, case when slug <> '' then concat('$label:', slug) end as tag
from (select doc_id, {_slug('text', "'-'")} as slug from documents)""",
    "label_keywords": f"""select p_partkey, array_to_string(list_transform(case when a = t then [a] else [a, t] end,
  lambda x: concat('$label:', x)), ',') as tags
from (select p_partkey, {_slug(_LABEL, "'_'")} as a, {_slug('p_type', "'_'")} as t from part)""",
    "label_folders": "select mirror, folder, array_to_string(attrs, ',') as attrs, list_pos from label_list",
    "labels_of_key": """select mirror, key, array_to_string(labels, ',') as labels from facts_all where len(labels) > 0""",
    "missing_keywords": """select c.mirror, c.copy_id, array_to_string(list_filter(p.tags,
  lambda x: not list_contains(list_transform(c.tags, lambda y: lower(y)), lower(x))), ',') as missing
from copies c join placed p using (mirror, key)""",
    "mirrors_needing_backfill": """select c.mirror, count(*) as n_records
from copies c join specs s using (mirror) join old_specs o using (mirror)
where (s.archive_on, s.sent_on, s.labels_on, s.propagate, s.keyword_prefix, s.keyword_replacement)
   <> (o.archive_on, o.sent_on, o.labels_on, o.propagate, o.keyword_prefix, o.keyword_replacement)
group by c.mirror""",
    "uid_windows": """select mirror, (uid - 1) // uid_batch as "window", count(*) as n, min(uid) as lo, max(uid) as hi
from msgs join specs using (mirror) group by 1, 2""",
    "meta_typed": f"""select event_id, case when v = '' then 'absent'
    when regexp_full_match(v, '[0-9]+') and try_cast(v as bigint) <= 4294967295 then 'ok' else 'corrupt' end as status,
  case when v = '' then 0 when regexp_full_match(v, '[0-9]+') and try_cast(v as bigint) <= 4294967295
    then cast(v as bigint) end as number
from (select event_id, {_NUMBER} as v from events)""",
    "ledger_antijoin": """select mirror, key, uid, n_records from firsts f
where not exists (select 1 from ledger l where l.mirror = f.mirror and l.key = f.key)""",
    "dest_guard": """select mirror, key, uid, status = 'in_dest' as in_dest from classified where status <> 'in_ledger'""",
    "route_bucket": "select mirror, key, wanted from placed",
    "folders_of_key": """select mirror, key, array_to_string(list_sort(list(distinct folder)), ',') as folders
from keyed group by mirror, key""",
    "membership_diff_uid": "select mirror, folder, key, uid, op from by_uid",
    "bucketed_diff": "select mirror, folder, key, uid, op from by_key",
    "bucketed_ingest_plan": """select mirror, key, uid, n_records, status, wanted, array_to_string(tags, ',') as tags from plan""",
    "membership_band_diff": "select mirror, folder, key, uid, op from by_uid",
    "membership_changed_bands": f"""select mirror, folder, uid_band from (
  select mirror, folder, cast(floor(uid / 400) as bigint) as uid_band,
    list_sort(list(uid) filter (internal_date >= '{fx.NEW_START}')) as now,
    list_sort(list(uid) filter (internal_date < '{fx.OLD_END}')) as before
  from msgs group by 1, 2, 3) where now is distinct from before""",
    "membership_diff_key": "select mirror, folder, key, uid, op from by_key",
    "membership_removed": """select mirror, folder, uid, key from members_old
where (mirror, folder, uid) not in (select (mirror, folder, uid) from members_new)""",
    "watch_list": "select mirror, folder, coalesce(kind, 'none') as kind from watch",
    "gate_ops": "select mirror, kind, key, folder, op, uid from ops",
    "locate_copies": """select mirror, key, wanted, coalesce(found, '') as found,
  case when found is null then 'not_found' else 'found' end as status from located""",
    "ledger_count": "select mirror, count(distinct key) as n_keys from keyed group by mirror",
    "ingest_plan": """select mirror, key, uid, n_records, status, wanted, array_to_string(tags, ',') as tags from plan""",
    "run_summary": """select mirror, cast(sum(n_records) as bigint) as candidates,
  count(*) filter (status = 'copy') as copied,
  cast(sum(n_records) - count(*) filter (status = 'copy') as bigint) as skipped_dup,
  count(*) filter (status = 'copy' and len(tags) > 0) as tags_set from plan group by mirror""",
    "tags_per_key": "select mirror, key, array_to_string(tags, ',') as tags from placed_all",
    "seed_keys": """select mirror, key, count(*) as n_records, bool_or(is_synth) as is_synth from placements p
where not exists (select 1 from ledger l where l.mirror = p.mirror and l.key = p.key) group by mirror, key""",
    "seed_counts": """select mirror, count(*) as n_scanned, count(distinct key) as n_keys from placements group by mirror""",
    "stale_mirrors": """select s.mirror, b.heartbeat, n.now - b.heartbeat as age_seconds,
  coalesce(n.now - b.heartbeat > 3 * s.poll_seconds, true) as stale
from specs s cross join (select max(cast(floor(epoch(internal_date)) as bigint)) as now from msgs) n
left join (select mirror, max(cast(floor(epoch(internal_date)) as bigint)) as heartbeat from msgs
           where folder = 'signup' group by mirror) b using (mirror)""",
    "first_per_key": "select mirror, key, uid, n_records, is_synth from firsts",
    "latest_member_uid": "select mirror, folder, key, max(uid) as uid from keyed group by mirror, folder, key",
    "net_member_change": """select mirror, folder, key, op, uid from (select *, row_number() over
  (partition by mirror, folder, key order by seq desc) as rn from change_log) where rn = 1""",
    "op_sequence": """select mirror, row_number() over (partition by mirror order by folder, (op = 'add'), uid, key) as seq,
  kind, key, folder, op from ops""",
    "oldest_ops": """select mirror, batch_id, seq, kind, key, folder, op from queue order by batch_id, seq, mirror limit 200""",
    "key_collisions": """select mirror, key, count(*) as n_records,
  count(distinct concat(sender, chr(1), subject, chr(1), size, chr(1), epoch_us(internal_date))) as n_contents
from keyed where not is_synth group by mirror, key
having count(distinct concat(sender, chr(1), subject, chr(1), size, chr(1), epoch_us(internal_date))) > 1""",
    "ledger_upsert": """select mirror, key, uid, copied_at from ledger
union all
select mirror, key, uid, copied_at from (select mirror, key, uid, cast(floor(epoch(internal_date)) as bigint) as copied_at,
    row_number() over (partition by mirror, key order by floor(epoch(internal_date)), uid) as rn from keyed) k
where rn = 1 and not exists (select 1 from ledger l where l.mirror = k.mirror and l.key = k.key)""",
    "members_next": f"""select mirror, folder, key, uid from (
  select *, row_number() over (partition by mirror, folder, key order by seq desc) as rn from (
    select mirror, folder, key, max(uid) as uid, -1 as seq, 'add' as op from members_old group by mirror, folder, key
    union all
    select mirror, folder, key, uid, seq, op from change_log where internal_date >= '{fx.NEW_START}'))
where rn = 1 and op = 'add'""",
    "queue_remaining": "select mirror, batch_id, seq, kind, key, folder, op from queue where value < 10",
    "folder_state_next": """select mirror, folder, epoch, last_uid from scanned_odd
union all
select mirror, folder, epoch, last_uid from stored_even s
where not exists (select 1 from scanned_odd n where n.mirror = s.mirror and n.folder = s.folder)""",
    "propagate_prefix": """select mirror, seq, kind, key, folder, op from (
  select mirror, batch_id * 1000000000 + seq as seq, kind, key, folder, op,
    row_number() over (partition by mirror order by batch_id * 1000000000 + seq) as nth, (select count(*) from queue) // 12 as page
  from queue) where nth > 2 * page""",
    "upgrade_labels": """select distinct mirror, folder, key, cast(0 as bigint) as uid from keyed""",
    "apply_moves": """select l.mirror, l.key, p.copy_id, l.found as from_folder, l.wanted as folder
from located l join specs s using (mirror)
join placements p on p.mirror = l.mirror and p.key = l.key and p.folder = l.found
where s.archive_on or s.sent_on""",
    "apply_tag_deltas": "select mirror, key, copy_id, tag, op from tag_rows",
    "tag_rejects": """select mirror, key, 'kept' as outcome, array_to_string(list_filter(tags,
    lambda x: allowed_tags is null or regexp_matches(x, allowed_tags)), ',') as tags
from placed_all join specs using (mirror)
union all
select mirror, key, 'refused', tag from (
  select p.mirror, p.key, unnest(p.tags) as tag, s.allowed_tags from placed_all p join specs s using (mirror))
where allowed_tags is not null and not regexp_matches(tag, allowed_tags)""",
    "dest_current": """select c.mirror, c.copy_id, c.key, coalesce(mv.folder, c.folder) as folder,
  coalesce(t.tags, '') as tags
from copies c
left join (select mirror, key, arg_max(case when op = 'add' then 'Mirror' else 'Archive' end,
             batch_id * 1000000000 + seq) as folder
           from queue where kind = 'move' group by mirror, key) mv using (mirror, key)
left join (select mirror, copy_id, string_agg(tag, ',' order by tag) filter (op = 'add') as tags
           from (select mirror, copy_id, arg_max(tag, ord) as tag, arg_max(op, ord) as op
                 from (select mirror, copy_id, unnest(tags) as tag, 'add' as op, -1 as ord from copies
                       union all
                       select c.mirror, c.copy_id, q.folder, q.op, q.batch_id * 1000000000 + q.seq
                       from copies c join queue q using (mirror, key) where q.kind = 'keyword')
                 group by mirror, copy_id, lower(tag))
           group by mirror, copy_id) t using (mirror, copy_id)""",
    "backfill_plan": """select mirror, copy_id, key, folder, wanted, array_to_string(missing, ',') as missing,
  case when wanted <> folder and len(missing) > 0 then 'move+tag' when wanted <> folder then 'move'
       when len(missing) > 0 then 'tag' else 'nothing' end as needs from repair""",
    "backfill_moves": """select mirror, folder, wanted, count(*) as n from repair where wanted <> folder group by all""",
    "backfill_tags": """select mirror, copy_id, unnest(missing) as tag, 'add' as op from repair""",
    "backfill_tag_groups": """select mirror, array_to_string(list_sort(missing), '|') as signature, count(*) as n from repair
where len(missing) > 0 group by 1, 2""",
    "audit_keys": "select mirror, key, wanted, n_records, copies, status from audited",
    "audit_report": """select mirror, wanted, status, count(*) as n_keys, cast(sum(copies) as bigint) as n_copies
from audited group by all""",
    "epoch_reset": f"""select s.mirror, e.epoch, coalesce(k.epoch, 0) <> 0 and k.epoch <> e.epoch as epoch_changed,
  count(m.uid) as candidates, min(m.uid) as first_uid
from specs s join (select mirror, max(epoch) as epoch from msgs group by mirror) e using (mirror)
left join (select mirror, 1 as epoch, max(uid) as last_uid from msgs
           where internal_date < '{fx.HALF}' and mirror <> 'm3' group by mirror) k using (mirror)
left join msgs m on m.mirror = s.mirror and (k.epoch is null or k.epoch <> e.epoch or m.uid > k.last_uid)
group by s.mirror, e.epoch, k.epoch""",
    "multi_mirror": f"""select mirror, in_ledger, count(*) as n_keys, cast(sum(n_records) as bigint) as n_records from (
  select mirror, concat('<', sender, '.', size, '@shared>') as key, count(*) as n_records,
    mirror = 'm0' and bool_or(internal_date < '{fx.LEDGER_END}') as in_ledger
  from msgs group by 1, 2) group by mirror, in_ledger""",
    "membership_ops": """select mirror, row_number() over (partition by mirror order by folder, (op = 'add'), uid, key) as seq,
  kind, key, folder, op
from (select d.*, w.kind from redo d join watch w using (mirror, folder)
      where w.kind is not null and not d.is_synth and (d.mirror, d.key) in (select (mirror, key) from copied))""",
    # First pass: older records by older memberships. Second: the rest by the newer ones, and real
    # keys copied before follow their memberships, tags only where changes are propagated.
    "reconcile_pass": f"""select f.mirror, f.key, f.uid, f.sender, f.size, f.raw, case when f.early and f.is_synth then o.wanted else n.wanted end as folder,
  array_to_string(list_sort(list_filter(
    case when f.early and (f.is_synth or not s.propagate) then o.tags else n.tags end,
    lambda x: s.allowed_tags is null or regexp_matches(x, s.allowed_tags))), ',') as tags,
  case when s.carry_seen and f.value >= 10 then '\\Seen' else '' end as flags
from (select k.mirror, k.key, k.is_synth, min(k.uid) as uid, arg_min(k.value, k.uid) as value,
        arg_min(k.sender, k.uid) as sender, arg_min(k.size, k.uid) as size, arg_min(concat('From: ', sender, chr(13), chr(10),
          'Subject: ', subject, chr(13), chr(10), chr(13), chr(10), message_id), k.uid) as raw,
        bool_or(k.internal_date < '{fx.OLD_END}') as early
      from keyed k group by k.mirror, k.key, k.is_synth) f
join specs s using (mirror) join placed_old o using (mirror, key) join placed_new n using (mirror, key)""",
    "stream_equals_batch": "select mirror, key, is_synth, 'copy' as source from firsts",
    "stream_dedup": """select mirror, key, case status when 'in_dest' then 'guard' else 'copy' end as source
from classified where status <> 'in_ledger'""",
    "stream_members": """select mirror, folder, key, arg_max(uid, seq) as uid from change_log group by mirror, folder, key
having arg_max(op, seq) = 'add'""",
    "stream_members_log": """select mirror, folder, key, max(uid) as uid from change_log group by mirror, folder, key
having arg_max(op, seq) = 'add'""",
    "stream_transitions": f"""select * from (with last as (
  select mirror, folder, key, b, max(seq) as seq, arg_max(op, seq) as op, arg_max(uid, seq) as uid
  from (select *, case when internal_date < '{fx.NEW_START}' then -1 when internal_date < '{fx.HALF}' then 0 else 1 end as b
        from change_log) group by mirror, folder, key, b),
steps as (select *, coalesce(lag(op) over w, '') = 'add' as was_present, lag(uid) over w as before_uid from last
  window w as (partition by mirror, folder, key order by b)),
told as (select mirror, folder, key, seq, was_present, op = 'add' as present, case when was_present then before_uid end as was_uid,
  case when op = 'add' then uid end as uid, cast(b as bigint) as batch from steps where b >= 0)
select * from told where was_present <> present or was_uid is distinct from uid)""",
    "stream_late_bodies": """select mirror, uid, case when uid % 4 in (0, 1) then concat('From: ', sender, chr(13), chr(10),
  'Subject: ', subject, chr(13), chr(10), chr(13), chr(10), message_id) else 'missing' end as raw from msgs""",
    # A key that passed in a period is remembered through the next two.
    "stream_dedup_within": f"""select * from (with recursive seen as (
  select distinct m.mirror, k.key, cast(floor(date_diff('day', date '{fx.FIRST_DAY}', cast(m.internal_date as date)) / 5) as bigint) as period
  from (select mirror, uid, internal_date, case when trim(message_id) <> '' then trim(message_id) end as real from msgs) m
  join (select mirror, uid, case when trim(message_id) <> '' then trim(message_id) else concat('synth-sha256:', sha256(concat(
    cast(floor(epoch(cast(date '{fx.FIRST_DAY}' + cast(5 * floor(date_diff('day', date '{fx.FIRST_DAY}', cast(internal_date as date)) / 5) as integer)
      as timestamp))) as bigint), '|0:|0:|0'))) end as key from msgs) k using (mirror, uid)),
kept as (
  select mirror, key, min(period) as period from seen group by mirror, key
  union all
  select k.mirror, k.key, s.period from kept k join seen s on s.mirror = k.mirror and s.key = k.key and s.period = (
    select min(x.period) from seen x where x.mirror = k.mirror and x.key = k.key and x.period > k.period + 2))
select mirror, key, period from kept)""",
    "stream_epoch_change": f"""select * from (with bodies_of as (select *, concat('From: ', sender, chr(13), chr(10), 'Subject: ', subject,
  chr(13), chr(10), chr(13), chr(10), message_id) as raw from keyed),
early as (select mirror, key, min(uid) as uid, arg_min(raw, uid) as raw from bodies_of
  where internal_date < '{fx.HALF}' group by mirror, key)
select * from early
union all
select mirror, key, min(uid) + case when mirror = 'm3' then 0 else 7 end,
  concat(case when mirror = 'm3' then '' else 'again ' end, arg_min(raw, uid))
from bodies_of where (mirror <> 'm3' or internal_date >= '{fx.LATE_START}')
  and (mirror, key) not in (select (mirror, key) from early) group by mirror, key)""",
    "propagate_plan": """select p.mirror, p.copy_id, 'move' as change, p.folder as from_folder, h.wanted as target
from (select w.mirror, w.key, w.wanted, min_by(c.folder, c.bucket_rank) as found
      from (select distinct q.mirror, q.key, p.wanted from queue q join placed p using (mirror, key)
            join specs s using (mirror) where q.kind = 'move' and (s.archive_on or s.sent_on)) w
      join placements c on c.mirror = w.mirror and c.key = w.key and c.folder <> w.wanted
      group by w.mirror, w.key, w.wanted) h
join placements p on p.mirror = h.mirror and p.key = h.key and p.folder = h.found
union all
select mirror, copy_id, concat('tag-', op), '', tag from tag_rows""",
}

ORACLES = {name: _with(sql) for name, sql in _QUERIES.items()}
