"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

from tessera.llm.mixing import DOMAINS, WEIGHTS
from tessera.llm.quality import CLASSES

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _mix(ratio: float, epochs: int, seed: int) -> str:
    levels = ["domain", "lang", "source"]
    number = "coalesce(try_cast(regexp_extract(source, '[0-9]+') AS INTEGER), 0)"
    parts = [
        f"d AS (SELECT doc_id, [{', '.join(repr(x) for x in DOMAINS)}][{number} % {len(DOMAINS)} + 1] AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source, CAST(len({_WORDS}) AS BIGINT) AS n_tokens FROM documents)",
        f"leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS supply, CAST(sum(n_tokens) * {epochs} AS DOUBLE) AS cap FROM d GROUP BY ALL)",
        f"b0 AS (SELECT 0 AS root, CAST(least(sum(cap), sum(supply) * {ratio}) AS DOUBLE) AS budget FROM leaf)",
    ]
    for i, level in enumerate(levels):
        path, above = ", ".join(levels[: i + 1]), ", ".join(["root", *levels[:i]])
        weight = "CASE " + " ".join(f"WHEN {level} = '{k}' THEN {v}::DOUBLE" for k, v in WEIGHTS[level].items()) + " ELSE 1.0::DOUBLE END" if level in WEIGHTS else "1.0::DOUBLE"
        parts += [
            f"o{i} AS (SELECT *, cap / weight AS ratio FROM (SELECT 0 AS root, {path}, CAST(sum(cap) AS DOUBLE) AS cap, {weight} AS weight FROM leaf GROUP BY {path}) JOIN b{i} USING ({above}))",
            f"p{i} AS (SELECT *, sum(cap) OVER w - cap AS caps, sum(weight) OVER (PARTITION BY {above}) - sum(weight) OVER w + weight AS weights FROM o{i} WINDOW w AS (PARTITION BY {above} ORDER BY ratio, {level} ROWS UNBOUNDED PRECEDING))",
            f"q{i} AS (SELECT *, (budget - caps) / weights AS lev, ratio <= (budget - caps) / weights AS isfull FROM p{i})",
            f"b{i + 1} AS (SELECT root, {path}, round(CASE WHEN isfull THEN cap ELSE least(cap, weight * max(CASE WHEN NOT isfull THEN lev END) OVER (PARTITION BY {above})) END, 3) AS budget FROM q{i})",
        ]
    return f"""WITH {', '.join(parts)},
        plan AS (SELECT l.*, budget, CASE WHEN supply > 0 THEN least({epochs}, floor(budget / supply)) ELSE 0 END AS full_epochs FROM leaf l JOIN b3 USING (domain, lang, source)),
        r AS (SELECT d.*, budget, full_epochs, budget - full_epochs * supply AS rest, ('0x' || substr(md5('{seed}/' || CAST(full_epochs AS INTEGER) || '/' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT AS place FROM d JOIN plan USING (domain, lang, source)),
        c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place, doc_id RANGE UNBOUNDED PRECEDING) AS run FROM r)
        SELECT doc_id, domain, lang, source, n_tokens, budget AS leaf_budget, CAST(CASE WHEN budget > 0 THEN full_epochs + CASE WHEN full_epochs < {epochs} AND run <= rest THEN 1 ELSE 0 END ELSE 0 END AS INTEGER) AS epochs FROM c"""


_JACCARD = rf"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n, md5(string_agg(k, '' ORDER BY k)) AS sig FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
    reach AS (SELECT DISTINCT a, a AS b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b),
    g AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a), d AS (SELECT a AS doc_id, count(*) AS n_links FROM l GROUP BY a)
    SELECT w.doc_id, coalesce(class_id, w.doc_id) AS class_id, CASE WHEN n.sig IS NULL THEN w.doc_id ELSE min(w.doc_id) OVER (PARTITION BY n.sig) END AS copy_id, coalesce(n_links, 0) AS n_links
    FROM w LEFT JOIN n USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN d USING (doc_id)"""

_REPEATS = rf"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    k AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
    low AS (SELECT k, min(doc_id) AS m FROM k GROUP BY k), gone AS (SELECT DISTINCT doc_id, i + j AS i FROM k JOIN low USING (k), range(50) r(j) WHERE m < doc_id),
    u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM u ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id), g AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN g USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def _js(own: str, ref: str) -> str:
    """Jensen-Shannon distance of two lists."""
    half = "CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q}) / 2)) ELSE 0 END"
    p, q = f"({own}[i] / list_sum({own}))", f"({ref}[i] / list_sum({ref}))"
    return f"CASE WHEN list_sum({own}) > 0 AND list_sum({ref}) > 0 THEN sqrt(greatest(list_sum(list_transform(range(1, len({ref}) + 1), lambda i: {half.format(p=p, q=q)} + {half.format(p=q, q=p)})) / 2, 0)) ELSE 0 END"


_HELD = ", ".join(f"(length(t) - length(regexp_replace(t, '{p}', '', 'g')))::DOUBLE" for p in (c.replace("'", "''") for c in CLASSES.values()))
_QUALITY = rf"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
    f AS (SELECT *, [{_HELD}] AS held, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, list_transform(w, lambda x: lower(x)) AS low FROM d),
    k AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 4], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
    twice AS (SELECT doc_id, i FROM k QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1), rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, range(5) r(j) GROUP BY doc_id),
    c AS (SELECT doc_id, lang, w, low, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, length(t) AS n_chars, list_append(held, greatest(length(t) - list_sum(held), 0)::DOUBLE) AS classes FROM f LEFT JOIN rep USING (doc_id)),
    sums AS (SELECT lang, [{', '.join(f'sum(classes[{i + 1}])' for i in range(len(CLASSES) + 1))}] AS ref_classes, sum(n_words) AS all_words FROM c GROUP BY lang),
    top AS (SELECT lang, word, n FROM (SELECT lang, word, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS r FROM (SELECT lang, unnest(low) AS word FROM c) GROUP BY lang, word) WHERE r <= 20),
    best AS (SELECT lang, list(word ORDER BY n DESC, word) AS ref_words, list(n::DOUBLE ORDER BY n DESC, word) AS known FROM top GROUP BY lang),
    refs AS (SELECT lang, ref_classes, coalesce(ref_words, []::VARCHAR[]) AS ref_words, list_append(coalesce(known, []::DOUBLE[]), (all_words - coalesce(list_sum(known), 0))::DOUBLE) AS ref_counts FROM sums LEFT JOIN best USING (lang)),
    o AS (SELECT *, list_transform(ref_words, lambda x: len(list_filter(low, lambda y: y = x))::DOUBLE) AS own FROM c JOIN refs USING (lang)),
    m AS (SELECT *, list_append(own, (n_words - coalesce(list_sum(own), 0))::DOUBLE) AS own_all FROM o),
    j AS (SELECT *, CASE WHEN n_chars >= 200 THEN {_js('classes', 'ref_classes')} END AS cd, CASE WHEN n_words >= 50 THEN {_js('own_all', 'ref_counts')} END AS wd, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(cd, 0) <= 0.27 AND coalesce(wd, 0) <= 0.45 AS kept, round(cd, 6) AS class_distance, round(wd, 6) AS word_distance FROM j"""


#: CRC-32 of a list of bytes `b`, with the table `tab` of its polynomial.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295)"
_SPELLING = rf"""WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(i))),
    runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents) GROUP BY ALL),
    coded AS (SELECT run, n, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [192 + (ord(x) >> 6)::BIGINT, 128 + (ord(x) & 63)::BIGINT] END)) AS b FROM runs),
    hashed AS (SELECT run, n, {_CRC} AS h FROM coded, crc),
    v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM hashed) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
    cut AS (SELECT word, n, i, substr(word, 1, i - 1) AS l, substr(word, i + 1) AS r FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
    shorter AS (SELECT DISTINCT cut.word, v.word AS near FROM cut JOIN v ON v.word = l || r),
    near AS (SELECT a.word, b.word AS near FROM cut a JOIN cut b ON a.i = b.i AND a.l = b.l AND a.r = b.r AND a.word <> b.word UNION SELECT word, near FROM shorter UNION SELECT near, word FROM shorter),
    best AS (SELECT near.word, near, n, count(*) OVER (PARTITION BY near.word) AS n_near, row_number() OVER (PARTITION BY near.word ORDER BY n DESC, near) AS r FROM near JOIN v ON v.word = near.near),
    f AS (SELECT v.word, v.n, CASE WHEN best.n >= 2 * v.n THEN near END AS form, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 2 * v.n THEN best.n END AS form_n FROM v LEFT JOIN best ON best.word = v.word AND best.r = 1),
    walk AS (SELECT word, word AS here FROM f UNION ALL SELECT walk.word, form FROM walk JOIN f ON f.word = walk.here WHERE form IS NOT NULL),
    ends AS (SELECT walk.word, here AS root FROM walk JOIN f ON f.word = walk.here WHERE form IS NULL)
    SELECT f.word, form, root, n, n_near, form_n FROM f JOIN ends USING (word)"""

#: The given pages hold one article element each, with a heading and paragraphs.
_ARTICLES = r"""WITH a AS (SELECT page_id, url, string_split_regex(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '</?(h1|p)>') AS blocks FROM pages),
    b AS (SELECT page_id, url, list_filter(list_transform(blocks, lambda x: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '') AS blocks FROM a)
    SELECT page_id, url, array_to_string(blocks, chr(10)) AS text, CAST(length(array_to_string(blocks, chr(10))) AS BIGINT) AS n_chars FROM b"""
ORACLE = {
    "op2_mix_sources": _mix(1.0, 4, 17),
    "op3_ngram_jaccard_join": _JACCARD,
    "op5_warc_roundtrip": """WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages), k AS (SELECT h, max(page_id) AS m FROM p WHERE n >= 1000 GROUP BY h)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN m <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN m <> page_id THEN m END AS refers_to FROM p LEFT JOIN k USING (h)""",
    "op7_cuckoo_dedup": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)""",
    "op9_divergence_quality": _QUALITY,
    "op10_seed_extend": _REPEATS,
    "op12_spelling_variants": _SPELLING,
    "op13_template_text": _ARTICLES,
}
