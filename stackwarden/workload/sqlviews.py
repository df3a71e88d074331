"""The derived views of `views`, in DuckDB SQL, for the correctness check."""

from __future__ import annotations

from . import views as V


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in values) + "]"


_DOC = """{i} AS asset_id, '/lib/' || source || '/' || lang || '_' || {i} ||
  CASE {i} % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' ELSE '.xlsx' END AS path,
  octet_length(encode(text))::BIGINT AS size,
  CASE {i} % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' ELSE 'xlsx' END AS kind,
  to_timestamp(1577836800 + {i} * 61) AT TIME ZONE 'UTC' AS mtime, text, encode(text) AS content"""

_UNIT = "list_transform({v}, lambda x: x / sqrt(list_inner_product({v}, {v})))"

VIEWS = {
    "assets": f"SELECT {_DOC.format(i='doc_id')} FROM documents",
    "near_docs": f"""SELECT doc_id, text, lang, source FROM documents UNION ALL
        SELECT doc_id + {V.COPY}, replace(translate(text, '{V._LETTERS}', '{V._LETTERS.upper()}'), ' ', '  '), lang, source FROM documents WHERE doc_id % 10 = 0""",
    "near_texts": f"SELECT {_DOC.format(i='doc_id')} FROM near_docs",
    "hashed": """SELECT *,
        sha256((CASE WHEN size <= 32768 THEN content ELSE content[1:16384] || content[-16384:] END) || encode('|' || size)) AS quick_hash,
        sha256(content) AS digest FROM assets""",
    "gray": """SELECT vec_id AS asset_id, list_sum(list_transform(embedding, lambda x, i:
            CASE WHEN x::DOUBLE > list_avg(embedding) THEN (1::HUGEINT << (64 - i)::HUGEINT) ELSE 0::HUGEINT END)) AS u FROM embeddings""",
    "base_hash": "SELECT asset_id, (CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END)::BIGINT AS a_hash FROM gray",
    "pictures": f"""SELECT asset_id, a_hash, '/pics/' || CASE WHEN asset_id % 3 = 0 THEN 'Screenshot_' ELSE 'img_' END || asset_id || '.png' AS path,
            20000 + asset_id * 7919 % 50000 AS size, 'image' AS kind, CASE WHEN asset_id % 3 = 0 THEN 3 ELSE 2 END AS radius
        FROM (SELECT asset_id, a_hash FROM base_hash UNION ALL
              SELECT asset_id + {V.COPY}, xor(a_hash, (1::BIGINT << (asset_id % 6)) - 1) FROM base_hash WHERE asset_id % 5 = 0)""",
    "codes": "SELECT a_hash AS code, radius, min(asset_id) AS id FROM pictures GROUP BY ALL",
    "raw_vectors": f"""SELECT vec_id AS asset_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings UNION ALL
        SELECT vec_id + {V.COPY}, list_transform(embedding, lambda x, k: x::DOUBLE + CASE WHEN k % 8 = vec_id % 8
            THEN 0.06::DOUBLE * (1 + vec_id % 6) ELSE 0::DOUBLE END) FROM embeddings WHERE vec_id % 5 = 0""",
    "vectors": f"""SELECT asset_id, {_UNIT.format(v='v')} AS vec,
            '/mix/f' || asset_id || CASE asset_id % 4 WHEN 2 THEN '.pdf' WHEN 3 THEN '.mp4' ELSE '.jpg' END AS path,
            30000 + asset_id * 104729 % 900000 AS size,
            CASE asset_id % 4 WHEN 2 THEN 'pdf' WHEN 3 THEN 'video' ELSE 'image' END AS kind FROM raw_vectors""",
    "exemplars": """SELECT 'F' || label AS folder, CASE WHEN vec_id % 2 = 0 THEN 'image' ELSE 'text' END AS modality, vec_id AS seq,
            list_transform(embedding, lambda x: x::DOUBLE) AS vec FROM embeddings""",
    "kept": "SELECT * FROM exemplars",
    "dims": "SELECT folder, modality, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM kept",
    "means": "SELECT folder, modality, list(m ORDER BY i) AS v FROM (SELECT folder, modality, i, avg(x) AS m FROM dims GROUP BY ALL) GROUP BY ALL",
    "centroids": f"SELECT folder, modality, {_UNIT.format(v='v')} AS centroid FROM means",
    "raw_queries": """SELECT vec_id AS asset_id, 'image' AS modality, list_transform(embedding, lambda x, k: x::DOUBLE + CASE WHEN k % 8 = vec_id % 8
            THEN 0.06::DOUBLE * (1 + vec_id % 6) ELSE 0::DOUBLE END) AS v FROM embeddings UNION ALL
        SELECT vec_id, 'text', list_transform(embedding, lambda x, k: x::DOUBLE + CASE WHEN k % 8 = (vec_id + 3) % 8
            THEN 0.05::DOUBLE * (1 + vec_id % 4) ELSE 0::DOUBLE END) FROM embeddings""",
    "queries_v": f"SELECT asset_id, modality, {_UNIT.format(v='v')} AS vec FROM raw_queries",
    "best_example": """SELECT q.asset_id, q.modality, k.folder, max(list_inner_product(q.vec, k.vec)) AS m
        FROM queries_v q JOIN kept k ON q.modality = k.modality GROUP BY ALL""",
    "scores": """SELECT b.asset_id, b.modality, b.folder, 0.6::DOUBLE * b.m + 0.4::DOUBLE * list_inner_product(q.vec, c.centroid) AS score
        FROM best_example b JOIN queries_v q ON b.asset_id = q.asset_id AND b.modality = q.modality
        JOIN centroids c ON b.folder = c.folder AND b.modality = c.modality""",
    "combined": """SELECT coalesce(i.asset_id, t.asset_id) AS asset_id, coalesce(i.folder, t.folder) AS folder,
            coalesce(0.55::DOUBLE * i.score + 0.45::DOUBLE * t.score, 0.85::DOUBLE * i.score, 0.85::DOUBLE * t.score) AS score
        FROM (SELECT * FROM scores WHERE modality = 'image') i FULL JOIN (SELECT * FROM scores WHERE modality = 'text') t
        ON i.asset_id = t.asset_id AND i.folder = t.folder""",
    "ranked_scores": """SELECT *, row_number() OVER w AS rnk, lead(score, 1, -1) OVER w AS second, score - lead(score, 1, -1) OVER w AS gap
        FROM combined WINDOW w AS (PARTITION BY asset_id ORDER BY score DESC, folder)""",
    "decided": """SELECT asset_id, folder,
            CASE WHEN score >= 0.70 THEN least(0.95::DOUBLE, 0.80::DOUBLE + score * 0.15)
                 WHEN score >= 0.45 AND gap >= 0.02 THEN least(0.85::DOUBLE, 0.65::DOUBLE + (score - 0.45) * 0.5 + gap * 0.3)
                 WHEN score >= 0.35 AND gap >= 0.05 THEN least(0.55::DOUBLE, 0.40::DOUBLE + (score - 0.35) * 0.5) END AS confidence,
            CASE WHEN score >= 0.70 THEN 'semantic_strong' WHEN score >= 0.45 AND gap >= 0.02 THEN 'semantic_match'
                 WHEN score >= 0.35 AND gap >= 0.05 THEN 'semantic_weak' END AS reason
        FROM ranked_scores WHERE rnk = 1 AND (score >= 0.70 OR (score >= 0.45 AND gap >= 0.02) OR (score >= 0.35 AND gap >= 0.05))""",
    "moves": "SELECT event_id AS move_id, ts, event_type AS folder, user_id AS asset_id FROM events",
    "rule_log": f"""SELECT ({_list(V.RULE_SIGNATURES)})[event_id % 5 + 1] AS pattern, 'Rules/' || (event_id % 17) AS folder, ts AS updated_at, event_id AS seq FROM events""",
    "rules": "SELECT pattern, arg_max(folder, (updated_at, seq)) AS folder FROM rule_log GROUP BY pattern",
    "part_folders": "SELECT p_name AS folder, count(*) AS used_count, min(p_partkey) AS first_seen FROM part GROUP BY ALL",
    "part_files": """SELECT p_partkey AS asset_id, p_type || ' ' || p_brand AS text,
        CASE WHEN p_partkey % 5 = 0 THEN replace(replace(p_name, ' ', '-'), 'widget', 'wdget') ELSE replace(p_name, ' ', '-') END || '_' || p_partkey || '.pdf' AS filename FROM part""",
    "keyword_docs": f"""SELECT doc_id AS asset_id, '/in/' || source || '/d' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.jpg' WHEN 1 THEN '.pdf' WHEN 2 THEN '.docx' ELSE '.mp4' END AS path,
        text || ({_list(V.PHRASES)})[doc_id % 9 + 1] AS text,
        CASE doc_id % 4 WHEN 0 THEN 'image' WHEN 1 THEN 'pdf' WHEN 2 THEN 'docx' ELSE 'video' END AS kind FROM documents""",
    "page_pictures": f"""SELECT page_id AS asset_id, replace(({_list([n.replace('%d', '#') for n in V.NAMES])})[page_id % 16 + 1], '#', page_id::VARCHAR) AS name,
        CASE WHEN page_id % 16 = 14 THEN 1080 ELSE 800 END AS width, CASE WHEN page_id % 16 = 14 THEN 2340 ELSE 600 + page_id % 400 END AS height,
        CASE WHEN page_id % 16 = 15 OR page_id % 4 = 2 THEN (1985 + page_id % 40) || ':05:06 07:08:09' END AS exif_original,
        CASE WHEN page_id % 3 = 0 THEN '2019:01:01 00:00:00' END AS exif_modified FROM pages""",
    "order_pictures": f"""SELECT o_orderkey AS asset_id,
        '/' || ({_list(V.FOLDERS_OF_FILES)})[o_orderkey % {len(V.FOLDERS_OF_FILES)} + 1] || '/o' || o_orderkey ||
            CASE WHEN o_orderkey % 7 = 0 THEN '.pdf' WHEN o_orderkey % 7 = 1 THEN '.heif' ELSE '.JPG' END AS path,
        10000 + o_orderkey * 97 % 60000 AS size,
        ({_list([s[0] for s in V.SIZES])})[o_orderkey % {len(V.SIZES)} + 1] AS width, ({_list([s[1] for s in V.SIZES])})[o_orderkey % {len(V.SIZES)} + 1] AS height,
        CASE WHEN o_orderkey % 11 = 0 THEN 'n/a' WHEN o_orderkey % 13 = 0 THEN '1890' || strftime(o_orderdate, ':%m:%d %H:%M:%S')
             ELSE strftime(o_orderdate, '%Y:%m:%d %H:%M:%S') END AS exif_original,
        CASE WHEN o_orderkey % 22 = 0 THEN '2005:01:01 00:00:00' END AS exif_modified FROM orders""",
    "pixels": """SELECT l_orderkey AS asset_id, CASE WHEN black THEN 5 ELSE (l_partkey * 37) % 256 END AS r,
        CASE WHEN black THEN 5 ELSE (l_suppkey * 53 + l_linenumber * 91) % 256 END AS g, CASE WHEN black THEN 5 ELSE (l_linenumber * 29) % 256 END AS b
        FROM (SELECT *, l_orderkey % 2 = 0 AND l_linenumber % 2 = 0 AS black FROM lineitem)""",
    "charts": """SELECT asset_id, avg((r > g + 30 AND r > b + 30)::INT) > 0.05 AND avg((g > r + 30 AND g > b + 30)::INT) > 0.05
        AND avg((floor(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b) < 30)::INT) > 0.40 AS is_chart FROM pixels GROUP BY ALL""",
    "batched": """SELECT *, CASE WHEN valid THEN sum(valid::INT) OVER (PARTITION BY batch_id ORDER BY position) - 1 END::BIGINT AS valid_no FROM
        (SELECT vec_id AS asset_id, label, vec_id % 9 <> 4 AS valid, row_number() OVER (ORDER BY vec_id) - 1 AS position,
            (row_number() OVER (ORDER BY vec_id) - 1) // 20 AS batch_id FROM embeddings)""",
    "reply_parts": """SELECT batch_id, label, '{"name":"' || CASE WHEN batch_id % 2 = 0 THEN 'Thème ' ELSE ' theme ' END || label || '","indices":[' ||
            string_agg(valid_no, ',' ORDER BY valid_no) || CASE WHEN label = 3 THEN ',99,"x",1.5' ELSE '' END || ']}' AS js FROM batched WHERE valid GROUP BY batch_id, label""",
    "reply_bodies": """SELECT batch_id, CASE WHEN batch_id % 7 = 0 THEN substring(string_agg(js, ',' ORDER BY label), 1, 40)
            ELSE '{"groups":[' || string_agg(js, ',' ORDER BY label) || ']}' END AS body FROM reply_parts GROUP BY batch_id""",
    "replies": """SELECT batch_id, CASE WHEN batch_id % 2 = 0 THEN '```json' || chr(10) || body || chr(10) || '```' ELSE 'Voici : ' || body END AS reply FROM reply_bodies""",
    "reply_texts": """SELECT batch_id, regexp_extract(regexp_replace(regexp_replace(trim(reply), '^```(?:json)?\\s*', '', 'i'), '```$', ''), '(?s)(\\{.*\\})', 1) AS js FROM replies""",
    "reply_ok": "SELECT batch_id, CASE WHEN json_valid(js) AND json_type(js, '$.groups') = 'ARRAY' THEN js END AS js FROM reply_texts",
    "reply_groups": """SELECT batch_id, g_pos, js ->> ('$.groups[' || g_pos || '].name') AS name, js -> ('$.groups[' || g_pos || '].indices') AS ix
        FROM (SELECT batch_id, js, unnest(range(json_array_length(js, '$.groups')::BIGINT)) AS g_pos FROM reply_ok WHERE js IS NOT NULL)""",
    "reply_items": """SELECT batch_id, g_pos, name, i_pos, CASE WHEN json_type(ix, '$[' || i_pos || ']') IN ('UBIGINT', 'BIGINT') THEN (ix ->> ('$[' || i_pos || ']'))::BIGINT END AS item_no
        FROM (SELECT *, unnest(range(json_array_length(ix)::BIGINT)) AS i_pos FROM reply_groups)""",
    "labelled": """SELECT trim(lower(strip_accents(r.name))) AS label_key, trim(r.name) AS name, r.batch_id, r.g_pos, r.i_pos, b.asset_id
        FROM reply_items r JOIN batched b ON r.batch_id = b.batch_id AND b.valid AND b.valid_no = r.item_no""",
    "label_names": "SELECT label_key, arg_min(name, (batch_id, g_pos)) AS suggested_name, min((batch_id, g_pos)) AS first_at FROM labelled GROUP BY ALL",
    "movers": f"""SELECT doc_id AS asset_id, ({_list(V.MOVE_NAMES)})[doc_id * 7 % 11 + 1] AS name,
        '/from/' || doc_id || '/' || ({_list(V.MOVE_NAMES)})[doc_id * 7 % 11 + 1] AS path,
        'By source\\' || source AS folder, '/sorted/By source/' || source AS dest_dir FROM documents""",
    "already_there": """SELECT '/sorted/By source/' || source AS dest_dir, unnest(CASE WHEN length(source) > 4 THEN ['a_3.pdf', 'a.pdf', 'b_1.docx', 'c_2'] ELSE ['a_1.pdf'] END) AS name
        FROM (SELECT DISTINCT source FROM documents)""",
    "frames": "SELECT vec_id // 3 AS asset_id, (vec_id % 4 <> 0)::INT AS mask, list_transform(embedding, lambda x: x::DOUBLE) AS vec FROM embeddings",
    "exact_g": "SELECT quick_hash, size, digest, count(*) AS n_members, min(asset_id) AS group_id FROM hashed WHERE size >= 1024 GROUP BY ALL HAVING count(*) >= 2",
    "exact_m": """SELECT g.group_id, 'exact' AS kind, h.quick_hash AS rep_hash, h.asset_id, h.path, h.size
        FROM hashed h JOIN exact_g g ON h.quick_hash = g.quick_hash AND h.size = g.size AND h.digest = g.digest WHERE h.size >= 1024""",
    "exact_s": "SELECT group_id, 'exact' AS kind, quick_hash AS rep_hash, n_members, n_members * size AS total_bytes, (n_members - 1) * size AS recoverable_bytes FROM exact_g",
}

# leader clusters one item at a time, in id order
VIEWS["code_run"] = """SELECT 0::BIGINT AS step, []::STRUCT(id BIGINT, code BIGINT)[] AS leaders, NULL::BIGINT AS id, NULL::BIGINT AS leader
    UNION ALL
    SELECT step + 1, CASE WHEN near IS NULL THEN list_append(leaders, {'id': nid, 'code': ncode}) ELSE leaders END, nid, coalesce(near, nid)
    FROM (SELECT r.step, r.leaders, o.id AS nid, o.code AS ncode,
            list_filter(r.leaders, lambda l: bit_count(xor(l.code, o.code)) <= o.radius)[1].id AS near
          FROM code_run r JOIN code_order o ON o.rn = r.step + 1)"""
VIEWS["code_order"] = "SELECT *, row_number() OVER (ORDER BY id) AS rn FROM codes"
VIEWS["picture_clusters"] = """SELECT p.*, c.leader AS group_id FROM pictures p JOIN codes k ON p.a_hash = k.code AND p.radius = k.radius
    JOIN code_run c ON c.id = k.id"""
VIEWS["vector_order"] = """SELECT asset_id AS id, vec, b, row_number() OVER (PARTITION BY b ORDER BY asset_id) AS rn FROM
    (SELECT asset_id, vec, CASE WHEN kind = 'pdf' THEN 'doc' ELSE 'image' END AS b FROM vectors)"""
VIEWS["vector_run"] = """SELECT 0::BIGINT AS step, b, []::STRUCT(id BIGINT, vec DOUBLE[])[] AS leaders, NULL::BIGINT AS id, NULL::BIGINT AS leader
    FROM (SELECT DISTINCT b FROM vector_order)
    UNION ALL
    SELECT step + 1, b, CASE WHEN near IS NULL THEN list_append(leaders, {'id': nid, 'vec': nvec}) ELSE leaders END, nid, coalesce(near, nid)
    FROM (SELECT r.step, r.b, r.leaders, o.id AS nid, o.vec AS nvec,
            list_filter(r.leaders, lambda l: list_inner_product(l.vec, o.vec) >= CASE o.b WHEN 'doc' THEN 0.82 ELSE 0.78 END)[1].id AS near
          FROM vector_run r JOIN vector_order o ON o.rn = r.step + 1 AND o.b = r.b)"""
VIEWS["clusters"] = """SELECT r.leader AS cluster_id, r.b AS kind, v.asset_id, v.path, v.size, v.kind AS file_kind FROM vectors v JOIN vector_run r ON r.id = v.asset_id"""
VIEWS["mixed"] = """SELECT cluster_id, kind, asset_id, path, size FROM clusters UNION ALL
    SELECT asset_id, 'other', asset_id, '/mix/x' || asset_id || '.zip', 1000 + asset_id FROM (SELECT 2000000 + page_id AS asset_id FROM pages)"""
VIEWS["text_m"] = """SELECT group_id, text_hash, asset_id, path, size FROM (
    SELECT *, count(*) OVER (PARTITION BY text_hash) AS n, min(asset_id) OVER (PARTITION BY text_hash) AS group_id FROM (
        SELECT *, CASE WHEN length(norm) >= 50 THEN sha256(norm) END AS text_hash FROM (
            SELECT *, trim(regexp_replace(lower(text), '[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{3000}]+', ' ', 'g')) AS norm FROM near_texts))
    WHERE text_hash IS NOT NULL) WHERE n >= 2"""
VIEWS["free_run"] = """SELECT 0::BIGINT AS step, dest_dir, taken, NULL::BIGINT AS asset_id, NULL::VARCHAR AS new_name FROM
    (SELECT m.dest_dir, coalesce(list(DISTINCT e.name) FILTER (e.name IS NOT NULL), []::VARCHAR[]) AS taken
     FROM (SELECT DISTINCT dest_dir FROM movers) m LEFT JOIN already_there e ON e.dest_dir = m.dest_dir GROUP BY ALL)
    UNION ALL
    SELECT step + 1, dest_dir, list_append(taken, new_name), asset_id, new_name FROM (
      SELECT r.step, r.dest_dir, r.taken, o.asset_id, CASE WHEN NOT list_contains(r.taken, o.name) THEN o.name ELSE
        list_filter(list_transform(range(1, len(r.taken) + 2), lambda n: o.stem || '_' || n || o.suffix), lambda c: NOT list_contains(r.taken, c))[1] END AS new_name
      FROM free_run r JOIN mover_order o ON o.rn = r.step + 1 AND o.dest_dir = r.dest_dir)"""
VIEWS["mover_order"] = """SELECT *, regexp_extract(name, '^(.+?)(\\.[^.]+)?$', 1) AS stem, coalesce(regexp_extract(name, '^.+(\\.[^.]+)$', 1), '') AS suffix,
    row_number() OVER (PARTITION BY dest_dir ORDER BY asset_id) AS rn FROM movers"""

# files whose text and name are matched against the part names used as folders
VIEWS["case_files"] = """SELECT 4000000 + asset_id AS asset_id, lower(text) AS text, lower(filename) AS filename FROM part_files UNION ALL
    SELECT asset_id, CASE WHEN kind = 'video' THEN '' ELSE lower(strip_accents(text)) END, lower(regexp_extract(path, '[^/]+$')) FROM keyword_docs UNION ALL
    SELECT 3000000 + asset_id, '', lower(name) FROM page_pictures"""
_SPLIT = "list_filter(regexp_split_to_array({c}, '[^a-z0-9]+'), lambda t: length(t) >= 3)"
VIEWS["case_words"] = f"""SELECT DISTINCT asset_id, unnest(a || b || list_transform(range(1, len(a)), lambda i: a[i] || a[i + 1])
        || list_transform(range(1, len(b)), lambda i: b[i] || b[i + 1])) AS word
    FROM (SELECT asset_id, {_SPLIT.format(c='text')} AS a, {_SPLIT.format(c='filename')} AS b FROM case_files)"""
_LONG_WORDS = "list_filter(string_split(folder, ' '), lambda t: length(t) >= 4)"
VIEWS["folder_needles"] = f"""SELECT *, unnest(needles) AS needle FROM (SELECT *, CASE WHEN len({_LONG_WORDS}) > 0 THEN {_LONG_WORDS}
    ELSE [replace(folder, ' ', '')] END AS needles FROM part_folders)"""
# For words of up to six letters a ratio of 0.85 means: equal, one letter more or less, or two more than six.
VIEWS["alike"] = """SELECT needle, word FROM (SELECT DISTINCT needle FROM folder_needles) n JOIN (SELECT DISTINCT word FROM case_words) w ON needle = word
    OR (abs(length(needle) - length(word)) = 1 AND levenshtein(needle, word) = 1)
    OR (length(word) = length(needle) + 2 AND length(needle) >= 6 AND levenshtein(needle, word) = 2)"""
VIEWS["whole_names"] = """SELECT f.asset_id, arg_min(p.folder, (-p.used_count, p.first_seen)) AS folder,
    arg_min(least(0.95::DOUBLE, 0.80::DOUBLE + CASE WHEN p.used_count >= 3 THEN 0.05::DOUBLE ELSE 0 END
        + CASE WHEN contains(f.t, p.c) AND contains(f.n, p.c) THEN 0.10::DOUBLE ELSE 0 END), (-p.used_count, p.first_seen)) AS confidence
    FROM (SELECT asset_id, regexp_replace(text, '[^a-z0-9]+', '', 'g') AS t, regexp_replace(filename, '[^a-z0-9]+', '', 'g') AS n FROM case_files) f
    JOIN (SELECT *, replace(folder, ' ', '') AS c FROM part_folders) p ON contains(f.t, p.c) OR contains(f.n, p.c) GROUP BY f.asset_id"""
VIEWS["word_confidence"] = """SELECT asset_id, folder, used_count, first_seen, CASE WHEN r >= 1 THEN 0.75::DOUBLE + CASE WHEN used_count >= 3 THEN 0.05::DOUBLE ELSE 0 END
        WHEN r >= 0.6 AND k >= 2 THEN 0.55::DOUBLE + 0.1::DOUBLE * r END AS conf
    FROM (SELECT w.asset_id, n.folder, n.used_count, n.first_seen, len(n.needles) AS k, count(DISTINCT n.needle) / len(n.needles) AS r
        FROM case_words w JOIN alike a ON a.word = w.word JOIN folder_needles n ON n.needle = a.needle GROUP BY w.asset_id, n.folder, n.used_count, n.first_seen, n.needles)"""
VIEWS["folder_match"] = """SELECT asset_id, folder, confidence FROM whole_names UNION ALL
    SELECT asset_id, arg_min(folder, (-conf, -used_count, first_seen)), max(conf) FROM word_confidence
    WHERE conf IS NOT NULL AND asset_id NOT IN (SELECT asset_id FROM whole_names) GROUP BY asset_id"""

_RECURSIVE = {"code_run", "vector_run", "free_run"}


def _deps(sql: str) -> list[str]:
    import re

    words = set(re.findall(r"[a-z_]+", sql))
    return [v for v in VIEWS if v in words]


def with_views(sql: str) -> str:
    """The query with the views it needs, in order, in front of it."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in order:
            return
        for d in _deps(VIEWS[name]):
            if d != name:
                add(d)
        order.append(name)

    for v in _deps(sql):
        add(v)
    if not order:
        return sql
    head = "WITH RECURSIVE " if _RECURSIVE & set(order) else "WITH "
    return head + ",\n".join(f"{v} AS ({VIEWS[v]})" for v in order) + "\n" + sql
