"""Pieces of SQL for the oracles: the same rules, stated for an engine without look-around."""

from __future__ import annotations

from inkstream import fixed
from inkstream.plans.views import JOB_EVENTS, MIXED, PROSE, SCRIPT, SIGNAL

WS = r"[\t-\r\x1c-\x1f\x{85}\p{Z}]"
W = r"[\p{L}\p{N}_]"
NN = "chr(10) || chr(10)"
QUOTED = fixed.QUOTED


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def word_list(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{WS}+'), lambda w: w <> '')"


def word_count(x: str) -> str:
    return f"len({word_list(x)})"


def hyphens(x: str) -> str:
    return rf"regexp_replace({x}, '({W}+)-\n({W}+)', '\1\2', 'g')"


def wraps(x: str) -> str:
    once = lambda y: rf"regexp_replace({y}, '({W})\n({W})', '\1 \2', 'g')"
    return once(once(x))


def clean(x: str) -> str:
    x = f"replace(replace(coalesce({x}, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    x = wraps(hyphens(x))
    x = rf"regexp_replace({x}, '[ \t]+', ' ', 'g')"
    return strip(rf"regexp_replace({x}, '\n{{3,}}', {NN}, 'g')")


def honorifics(x: str) -> str:
    for short, long in fixed.HONORIFICS:
        for _ in range(2):
            x = rf"regexp_replace({x}, '(^|[^\p{{L}}\p{{N}}_]){short}\.{WS}+', '\1{long} ', 'g')"
    return x


def thousands(x: str) -> str:
    for _ in range(2):
        x = rf"regexp_replace({x}, '(\p{{Nd}}),(\p{{Nd}}\p{{Nd}}\p{{Nd}})([^\p{{L}}\p{{N}}_]|$)', '\1' || chr(1) || '\2\3', 'g')"
    return f"replace({x}, chr(1), '')"


def dashes(x: str) -> str:
    return f"replace(replace({x}, '—', ' -- '), '–', ' - ')"


def ellipses(x: str) -> str:
    return rf"regexp_replace({x}, '\.{{3,}}', '...', 'g')"


def collapse(x: str) -> str:
    return strip(f"regexp_replace({x}, '{WS}+', ' ', 'g')")


def normalize(x: str) -> str:
    return collapse(ellipses(dashes(thousands(honorifics(x)))))


def paragraphs(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, {NN}), lambda p: {strip('p')}), lambda p: p <> '')"


def heading(x: str) -> str:
    return strip(f"regexp_replace({x}, '^#+{WS}*', '')")


def chapters(view: str) -> str:
    """CTEs from a view of (doc_id, raw_text) to ``chapters``."""
    return rf"""
cleaned AS (SELECT doc_id, {clean('raw_text')} AS cleaned FROM {view}),
paras AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS pos FROM (SELECT doc_id, {paragraphs('cleaned')} AS ps FROM cleaned)),
grouped AS (SELECT *, starts_with(p, '#') AS h, sum(starts_with(p, '#')::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS grp FROM paras),
bodies AS (SELECT doc_id, grp, string_agg(p, {NN} ORDER BY pos) AS content FROM grouped WHERE NOT h GROUP BY doc_id, grp),
heads AS (SELECT doc_id, grp, {heading('p')} AS title FROM grouped WHERE h),
kinds AS (SELECT doc_id, bool_or(h) AS any_heading, bool_or(NOT h) AS any_body FROM grouped GROUP BY doc_id),
chapters AS (
    SELECT doc_id, chapter_index, title, content, {word_count('content')}::INT AS word_count FROM (
        SELECT b.doc_id, (row_number() OVER (PARTITION BY b.doc_id ORDER BY b.grp) - 1)::INT AS chapter_index, CASE WHEN b.grp = 0 THEN 'Prologue' ELSE heads.title END AS title, content
        FROM bodies b JOIN kinds ON kinds.doc_id = b.doc_id AND any_heading LEFT JOIN heads ON heads.doc_id = b.doc_id AND heads.grp = b.grp
        UNION ALL
        SELECT c.doc_id, 0, CASE WHEN any_heading THEN 'Chapter 1' ELSE '' END, CASE WHEN k.doc_id IS NULL THEN '' ELSE cleaned END
        FROM cleaned c LEFT JOIN kinds k ON k.doc_id = c.doc_id WHERE k.doc_id IS NULL OR NOT any_heading OR NOT any_body))"""


def sentence_array(x: str) -> str:
    return rf"""string_split(regexp_replace({x}, '([.!?…]){WS}+([A-Z"“0-9])', '\1' || chr(1) || '\2', 'g'), chr(1))"""


CHUNKS = rf"""
cparas AS (SELECT doc_id, chapter_index, unnest(ps) AS p, generate_subscripts(ps, 1) AS pp FROM (
    SELECT doc_id, chapter_index, {paragraphs("CASE WHEN title <> '' THEN '# ' || title || chr(10) || chr(10) || content ELSE content END")} AS ps FROM chapters)),
kinded AS (SELECT *, CASE WHEN starts_with(p, '#') THEN 'heading' WHEN p IN ('*', '* * *', '---', '***') THEN 'section_break' ELSE 'prose' END AS pk FROM cparas),
pieces AS (
    SELECT doc_id, chapter_index, pp, 2 * generate_subscripts(g, 1) AS k, 'narration' AS kind, {strip('unnest(g)')} AS text
    FROM (SELECT *, string_split_regex(p, '{QUOTED}') AS g FROM kinded WHERE pk = 'prose')
    UNION ALL
    SELECT doc_id, chapter_index, pp, 2 * generate_subscripts(g, 1) + 1, 'dialogue', {strip('substr(unnest(g), 2)')}
    FROM (SELECT *, list_transform(regexp_extract_all(p, '{QUOTED}'), lambda x: substr(x, 1, length(x) - 1)) AS g FROM kinded WHERE pk = 'prose')),
segments AS (SELECT *, {word_count('text')} AS wc FROM pieces WHERE text <> ''),
sentences AS (SELECT doc_id, chapter_index, pp, k, kind, unnest(s) AS text, generate_subscripts(s, 1) AS i FROM (SELECT *, {sentence_array('text')} AS s FROM segments WHERE wc > {fixed.MAX_WORDS})),
counted AS (SELECT *, {word_count('text')} AS wc FROM sentences),
packed AS (
    SELECT doc_id, chapter_index, pp, k, i, wc AS n, 1 AS pack FROM counted WHERE i = 1
    UNION ALL
    SELECT c.doc_id, c.chapter_index, c.pp, c.k, c.i, CASE WHEN p.n + c.wc > {fixed.TARGET_WORDS} THEN c.wc ELSE p.n + c.wc END, p.pack + (p.n + c.wc > {fixed.TARGET_WORDS})::INT
    FROM packed p JOIN counted c ON c.doc_id = p.doc_id AND c.chapter_index = p.chapter_index AND c.pp = p.pp AND c.k = p.k AND c.i = p.i + 1),
packs AS (SELECT c.doc_id, c.chapter_index, c.pp, c.k, c.kind, pack, {strip("string_agg(c.text, ' ' ORDER BY c.i)")} AS text
          FROM counted c JOIN packed p USING (doc_id, chapter_index, pp, k, i) GROUP BY ALL),
spoken AS (
    SELECT doc_id, chapter_index, pp, 0 AS k, 0 AS pack, 'heading' AS chunk_type, {heading('p')} AS text, {fixed.HEADING_BEFORE_MS} AS before, {fixed.HEADING_AFTER_MS} AS after FROM kinded WHERE pk = 'heading'
    UNION ALL SELECT doc_id, chapter_index, pp, 0, 0, 'section_break', '', 0, {fixed.BREAK_AFTER_MS} FROM kinded WHERE pk = 'section_break'
    UNION ALL SELECT doc_id, chapter_index, pp, k, 0, kind, text, 0, CASE WHEN kind = 'dialogue' THEN {fixed.DIALOGUE_MS} ELSE {fixed.MID_MS} END FROM segments WHERE wc <= {fixed.MAX_WORDS}
    UNION ALL SELECT doc_id, chapter_index, pp, k, pack, kind, text, 0, CASE WHEN pack < max(pack) OVER (PARTITION BY doc_id, chapter_index, pp, k) THEN {fixed.MID_MS}
                     WHEN kind = 'dialogue' THEN {fixed.DIALOGUE_MS} ELSE {fixed.NARRATION_LAST_MS} END FROM packs),
chunks AS (
    SELECT doc_id, chapter_index, (row_number() OVER (PARTITION BY doc_id, chapter_index ORDER BY pp, k, pack) - 1)::INT AS chunk_index, chunk_type, text, before::INT AS pause_before_ms,
           (CASE WHEN chunk_type IN ('narration', 'dialogue') AND row_number() OVER (PARTITION BY doc_id, chapter_index, pp ORDER BY k DESC, pack DESC) = 1 THEN greatest(after, {fixed.PARAGRAPH_MS}) ELSE after END)::INT AS pause_after_ms
    FROM spoken)"""


def prose_chapters() -> str:
    return f"WITH RECURSIVE {PROSE},{chapters('prose')}"


def chunked(view: str = "script") -> str:
    """CTEs from the driver's tables to ``chunks``."""
    return f"WITH RECURSIVE { {'script': SCRIPT, 'prose': PROSE, 'mixed': MIXED}[view]},{chapters(view)},{CHUNKS}"


_TAG = "CASE WHEN {0} LIKE '%Alice said%' THEN 'Alice' WHEN {0} LIKE '%Marcus said%' THEN 'Marcus' WHEN {0} LIKE '%the clerk said%' THEN 'The Clerk' END"

#: CTEs from ``chunks`` of the script to its speakers: the tag after a line or before it, else the other partner, else the last speaker.
SPEAKERS = rf"""
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chapter_index, chunk_index) - 1 AS seq FROM chunks),
beside AS (SELECT *, lag(CASE WHEN chunk_type = 'narration' THEN text END) OVER w AS before_it, lead(CASE WHEN chunk_type = 'narration' THEN text END) OVER w AS after_it FROM numbered WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
tagged AS (SELECT doc_id, seq, text, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS line, coalesce({_TAG.format('after_it')}, {_TAG.format('before_it')}) AS tag FROM beside WHERE chunk_type = 'dialogue'),
told AS (
    SELECT doc_id, line, seq, text, coalesce(tag, 'Unknown Speaker') AS who, tag AS last, NULL::VARCHAR AS partner FROM tagged WHERE line = 1
    UNION ALL
    SELECT doc_id, line, seq, text, coalesce(who, 'Unknown Speaker'), coalesce(who, last), CASE WHEN who IS NULL OR who = last THEN partner ELSE last END
    FROM (SELECT t.doc_id, t.line, t.seq, t.text, coalesce(t.tag, p.partner, p.last) AS who, p.last, p.partner FROM told p JOIN tagged t ON t.doc_id = p.doc_id AND t.line = p.line + 1)),
spoken_by AS (SELECT doc_id, seq, text, who AS character, CASE who WHEN 'Alice' THEN 'female' WHEN 'Unknown Speaker' THEN 'unknown' ELSE 'male' END AS gender FROM told),
heard AS (SELECT *, lag(character) OVER (PARTITION BY doc_id ORDER BY seq) AS prev FROM spoken_by WHERE character <> 'Unknown Speaker'),
partners AS (SELECT DISTINCT doc_id, character AS name, prev AS peer FROM heard WHERE prev <> character UNION SELECT DISTINCT doc_id, prev, character FROM heard WHERE prev <> character),
profiles AS (
    SELECT h.doc_id, h.character AS name, min(h.gender) AS gender, count(*) AS line_count, coalesce(any_value(p.peers), '') AS interacts_with
    FROM heard h LEFT JOIN (SELECT doc_id, name, string_agg(peer, ',' ORDER BY peer) AS peers FROM partners GROUP BY ALL) p ON p.doc_id = h.doc_id AND p.name = h.character GROUP BY h.doc_id, h.character),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, gender ORDER BY line_count DESC, name) AS r FROM profiles)"""


def pool(engine: str) -> str:
    """The voice of the r-th man or woman of a document: no pool here is exhausted."""
    of = lambda kind: "[" + ", ".join(q(v) for v in fixed.VOICE_POOLS[engine][kind]) + "][r]"
    return f"CASE gender WHEN 'female' THEN {of('female')} ELSE {of('male')} END"


PLACED = rf"""
sequenced AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chapter_index, chunk_index) - 1 AS seq, {normalize('text')} AS spoken_text FROM chunks),
sized AS (SELECT *, CASE WHEN chunk_type = 'section_break' OR spoken_text = '' THEN 0 ELSE greatest(240, trunc(greatest(1, {word_count('spoken_text')})::DOUBLE / 3.2::DOUBLE * 24000)::BIGINT) END AS n FROM sequenced),
measured AS (SELECT *, CASE WHEN n = 0 THEN 0 ELSE n - CASE WHEN sum(n) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 THEN least(840, n) ELSE 0 END
                    + trunc(pause_after_ms / 1000.0::DOUBLE * 24000)::BIGINT END AS added FROM sized),
placed AS (SELECT *, (sum(added) OVER (PARTITION BY doc_id ORDER BY seq))::BIGINT AS fin, (sum(added) OVER (PARTITION BY doc_id ORDER BY seq) - added)::BIGINT AS start FROM measured),
opening AS (SELECT *, lag(chapter_index) OVER (PARTITION BY doc_id ORDER BY seq) AS was, max(fin) OVER (PARTITION BY doc_id) AS total FROM placed),
marks AS (
    SELECT o.doc_id, (row_number() OVER (PARTITION BY o.doc_id ORDER BY seq) - 1)::INT AS ord, o.chapter_index,
           CASE WHEN chunk_type = 'heading' THEN spoken_text ELSE coalesce(c.title, 'Chapter ' || (o.chapter_index + 1)) END AS title,
           trunc(start / 24000::DOUBLE * 1000.0)::BIGINT AS start_ms,
           trunc(coalesce(lead(start) OVER (PARTITION BY o.doc_id ORDER BY seq), total) / 24000::DOUBLE * 1000.0)::BIGINT AS end_ms
    FROM opening o LEFT JOIN chapters c ON c.doc_id = o.doc_id AND c.chapter_index = o.chapter_index
    WHERE chunk_type = 'heading' OR was IS NULL OR was <> o.chapter_index)"""

__all__ = ["CHUNKS", "JOB_EVENTS", "PLACED", "SIGNAL"]
