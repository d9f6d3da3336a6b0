"""DuckDB SQL twins of the queries, over the driver's tables as views."""

from __future__ import annotations

PATH = """'/lib/' || source || '/' || lang || '/' || doc_id ||
  CASE lang WHEN 'en' THEN '.jpg' WHEN 'de' THEN '.PNG' WHEN 'fr' THEN '.Tif' ELSE '.txt' END"""

# Gray picture of four-character windows, its low cosine coefficients, bits above their median.
PICTURES = f"""
codes AS (
  SELECT doc_id, unnest(cs) AS code, unnest(range(len(cs))) AS pos FROM (
    SELECT doc_id, list_transform(regexp_extract_all(text, '(?s).'), lambda c: unicode(c)::BIGINT) AS cs
    FROM documents)),
windows AS (
  SELECT doc_id, (((code * 131 + lead(code, 1) OVER w) * 131 + lead(code, 2) OVER w) * 131
                  + lead(code, 3) OVER w) % 1048573 % 1024 AS cell
  FROM codes WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
cells AS (
  SELECT doc_id, cell // 32 AS r, cell % 32 AS c, count(*)::DOUBLE AS level
  FROM windows WHERE cell IS NOT NULL GROUP BY ALL),
cosines AS (
  SELECT f, p, cos(pi() * (2 * p + 1) * f / 64) AS x
  FROM (SELECT unnest(range(8)) AS f) CROSS JOIN (SELECT unnest(range(32)) AS p)),
halves AS (
  SELECT doc_id, r, f AS v, sum(level * x) AS h FROM cells JOIN cosines ON p = c GROUP BY ALL),
coefficients AS (
  SELECT doc_id, f AS u, v, round(sum(h * x), 3) AS k FROM halves JOIN cosines ON p = r GROUP BY ALL),
medians AS (SELECT doc_id, median(k) AS m FROM coefficients GROUP BY doc_id),
hashes AS (
  SELECT doc_id, bit_or(CASE WHEN k > m THEN 1::UBIGINT << (63 - (u * 8 + v))::UBIGINT ELSE 0::UBIGINT END) AS b
  FROM coefficients JOIN medians USING (doc_id) GROUP BY doc_id),
pictures AS MATERIALIZED (
  SELECT d.doc_id, d.lang, sha256(d.text) AS sha, coalesce(h.b, 0::UBIGINT) AS b
  FROM documents d LEFT JOIN hashes h USING (doc_id)),
contents AS MATERIALIZED (SELECT sha, min(doc_id) AS id, min(b) AS b FROM pictures GROUP BY sha)"""

FOLDERS = r"""
folders AS (
  SELECT DISTINCT path FROM (
    SELECT regexp_extract(url, '^([a-z]+://[^/]+)', 1) AS path FROM pages
    UNION ALL SELECT regexp_extract(url, '^([a-z]+://[^/]+/[^/]+)', 1) FROM pages) WHERE path <> '')"""

CHANGES = """
changes AS (
  SELECT event_id AS ord, '/u/' || user_id || '/' || event_type || '.jpg' AS path, ts, value, event_type,
         CAST(floor(value) AS BIGINT) AS content_id, CAST(floor(value * 100) AS BIGINT) AS file_size
  FROM events)"""

ENDS = (
    CHANGES
    + """,
ends AS (SELECT path, min(ord) AS a, max(ord) AS z FROM changes GROUP BY path),
before AS (SELECT c.* FROM changes c JOIN ends ON c.ord = a),
batch AS (SELECT c.* FROM changes c JOIN ends ON c.ord = z AND a < z)"""
)

LABELLED = """
labelled AS (
  SELECT d.doc_id AS id, text, embedding,
    CASE WHEN quality IS NULL THEN 'UPLOADED' WHEN toxic = 1 THEN 'ERROR'
         WHEN quality = 1 THEN 'INDEXED' ELSE 'INDEXING' END AS status
  FROM documents d LEFT JOIN labels USING (doc_id) LEFT JOIN embeddings e ON e.vec_id = d.doc_id)"""

STORE = """
content AS (
  SELECT o_orderkey AS id, CAST(floor(o_totalprice * 100) AS BIGINT) AS uploaded_bytes, o_orderdate AS uploaded_at,
    CASE WHEN o_orderpriority = '1-URGENT' THEN o_custkey END AS dup_group,
    CASE o_orderstatus WHEN 'O' THEN 'INDEXED' WHEN 'F' THEN 'UPLOADED' ELSE 'ERROR' END AS status FROM orders),
files AS (
  SELECT l_orderkey AS content_id,
    CASE l_returnflag WHEN 'A' THEN 'DUPLICATE' WHEN 'R' THEN 'SIMILAR' ELSE 'ORIGINAL' END AS image_type
  FROM lineitem)"""

PARTS = """
uploads AS (
  SELECT o_orderkey AS id, CASE WHEN o_orderpriority <> '1-URGENT' THEN 'u' || o_orderkey END AS upload_id,
    o_custkey AS content_id, o_orderdate AS initiated_at, CAST(floor(o_totalprice * 100) AS BIGINT) AS total_size,
    CASE o_orderstatus WHEN 'F' THEN 'UPLOADED' WHEN 'P' THEN 'PENDING' ELSE 'UPLOADING' END AS status FROM orders),
plan AS (
  SELECT id AS upload_row_id, CAST(n AS INTEGER) AS part_number, (n - 1) * 8388608 AS part_offset,
    least(8388608, total_size - (n - 1) * 8388608) AS part_size
  FROM (SELECT id, total_size, unnest(range(1, (total_size + 8388607) // 8388608 + 1)) AS n
        FROM uploads WHERE total_size > 8388608)),
ledger AS (
  SELECT l_orderkey AS upload_row_id, l_linenumber AS part_number, max(l_partkey) AS ledger_id,
    bool_or(l_linestatus = 'F') AS done,
    max(CASE WHEN l_linestatus = 'F' THEN l_partkey || '-' || l_suppkey END) AS etag
  FROM lineitem GROUP BY ALL)"""

QUERY = "(SELECT list_transform(range(64), lambda i: cos(i::DOUBLE)) AS q)"
SCORED = f"""
scored AS (
  SELECT vec_id AS id, 'photos/' || vec_id AS s3_path, list_cosine_similarity(embedding::DOUBLE[], q) AS s
  FROM embeddings, {QUERY}),
found AS (SELECT * FROM (SELECT * FROM scored ORDER BY round(s, 9) DESC, id LIMIT 20) WHERE s >= 0.22)"""

DISTANCE = "CAST(bit_count(xor({0}, {1})) AS INTEGER)"
NEAREST = """
nodes AS (SELECT b, min(id) AS o FROM contents GROUP BY b),
near AS (SELECT x.id, n.b, n.o, bit_count(xor(x.b, n.b)) AS d
         FROM contents x JOIN nodes n ON n.o < x.id AND bit_count(xor(x.b, n.b)) <= 5),
best AS (SELECT id, arg_min(b, d::BIGINT * 1000000000 + o) AS b, min(d) AS d FROM near GROUP BY id),
matched AS MATERIALIZED (
  SELECT best.id, max(c.id) AS matched_id, CAST(min(best.d) AS INTEGER) AS distance
  FROM best JOIN contents c ON c.b = best.b AND c.id < best.id GROUP BY best.id)"""
WALK = """
walk(id, anc) AS (
  SELECT id, matched_id FROM matched UNION ALL
  SELECT w.id, m.matched_id FROM walk w JOIN matched m ON m.id = w.anc),
roots AS (SELECT id, min(anc) AS root FROM walk GROUP BY id)
SELECT id, root AS dup_group, distance AS near_dup_distance FROM matched JOIN roots USING (id)
UNION ALL SELECT DISTINCT root, root, CAST(NULL AS INTEGER) FROM roots"""

# What each content holds, and how many files beyond the original refer to it.
PER_CONTENT = """per_content AS (
          SELECT c.id, any_value(c.uploaded_bytes) AS bytes, sum(CASE f.image_type WHEN 'ORIGINAL' THEN 0 ELSE 1 END) AS copies
          FROM files f INNER JOIN content c ON c.id = f.content_id GROUP BY c.id)"""

NEAR_STORED = f"""WITH {PICTURES},
    docs AS (SELECT p.*, l.doc_id IS NOT NULL AS labelled
             FROM pictures p LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)),
    stored AS (SELECT sha, min(doc_id) AS id, min(b) AS b FROM docs WHERE labelled GROUP BY sha),
    nodes AS (SELECT b, min(id) AS o, max(id) AS content_id FROM stored GROUP BY b)
    SELECT doc_id, arg_min(content_id, d::BIGINT * 1000000000 + o) AS content_id,
           CAST(min(d) AS INTEGER) AS distance
    FROM (SELECT doc_id, content_id, o, bit_count(xor(x.b, n.b)) AS d FROM docs x, nodes n
          WHERE NOT labelled AND bit_count(xor(x.b, n.b)) <= 5) GROUP BY doc_id"""

SQL = {
    "content_hash": "SELECT doc_id, sha256(text) AS sha256_hex FROM documents",
    "mime_type": """SELECT doc_id,
        CASE lang WHEN 'en' THEN '.jpg' WHEN 'de' THEN '.png' WHEN 'fr' THEN '.tif' ELSE '.txt' END AS extension,
        CASE lang WHEN 'en' THEN 'image/jpeg' WHEN 'de' THEN 'image/png' WHEN 'fr' THEN 'image/tiff'
             ELSE 'text/plain' END AS mime, strlen(text) AS file_size FROM documents""",
    "object_key": """SELECT doc_id, 'photos/' || sha256(text) AS object_key,
        'album/photos/' || sha256(text) AS object_path FROM documents""",
    "phash": f"WITH {PICTURES} SELECT doc_id, lower(lpad(to_hex(b), 16, '0')) AS phash FROM pictures",
    "hamming": """SELECT doc_id, CAST(bit_count(xor(('0x' || sha256(text)[1:16])::UBIGINT,
        ('0x' || md5(text)[1:16])::UBIGINT)) AS INTEGER) AS distance FROM documents""",
    "l2_normalize": """SELECT vec_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS pos,
        round(unnest(embedding)::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS x
        FROM embeddings""",
    "cosine_score": f"""SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 4) AS score
        FROM embeddings, {QUERY}""",
    "fmt_bytes": """SELECT o_orderkey, n AS bytes,
        CASE WHEN n < 1024 THEN printf('%.1f B', n::DOUBLE) WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0::DOUBLE)
             WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0::DOUBLE)
             WHEN n < 1099511627776 THEN printf('%.1f GB', n / 1073741824.0::DOUBLE)
             ELSE printf('%.1f TB', n / 1099511627776.0::DOUBLE) END AS shown
        FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * o_custkey * o_custkey AS n FROM orders)""",
    "folder_title": """SELECT doc_id,
        CASE WHEN lang = 'de' THEN upper(source) ELSE source END AS title FROM documents""",
    "image_filter": f"""SELECT doc_id, path FROM (SELECT doc_id, {PATH} AS path FROM documents)
        WHERE regexp_matches(lower(path), '[^/]\\.(jpg|jpeg|png|webp|gif|bmp|tiff|tif|ico)$')""",
    "needs_embedding": f"""WITH {LABELLED} SELECT id, status FROM labelled
        WHERE NOT (status = 'INDEXED' AND embedding IS NOT NULL)""",
    "recovery_queue": f"WITH {LABELLED} SELECT id, status FROM labelled WHERE status <> 'INDEXED'",
    "exact_dedup": """SELECT sha256(text) AS sha256_hex, min(doc_id) AS first_doc, count(*) AS copies
        FROM documents GROUP BY 1""",
    "store_once": """SELECT DISTINCT sha256(text) AS sha256_hex, 'photos/' || sha256(text) AS object_key
        FROM documents WHERE lang = 'en'
        AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang <> 'en')""",
    "incremental_scan": f"""WITH {CHANGES} SELECT path FROM changes GROUP BY path
        HAVING epoch_ms(max(ts)) IS DISTINCT FROM epoch_ms(max(ts) FILTER (WHERE value < 100))""",
    "missing_files": f"WITH {CHANGES} SELECT path FROM changes GROUP BY path HAVING max(value) <= 200",
    "latest_per_path": f"""WITH {CHANGES} SELECT path, ord AS event_id, event_type AS kind FROM changes
        QUALIFY row_number() OVER (PARTITION BY path ORDER BY ts DESC, ord DESC) = 1""",
    "upsert_files": f"""WITH {ENDS} SELECT a.ord AS id, a.path AS local_path,
        'sha-' || coalesce(b.content_id, a.content_id) AS sha256_hex,
        coalesce(b.file_size, a.file_size) AS file_size,
        CASE WHEN b.content_id <> a.content_id THEN 'DUPLICATE' ELSE 'ORIGINAL' END AS image_type,
        coalesce(b.content_id, a.content_id) AS content_id, epoch_us(coalesce(b.ts, a.ts)) AS mtime_us
        FROM before a LEFT JOIN batch b USING (path)""",
    "file_classification": f"""WITH {ENDS}, moves AS (
          SELECT z.ord, a.content_id AS old_id, z.content_id AS new_id FROM batch z JOIN before a USING (path)
          WHERE a.content_id <> z.content_id),
        deltas AS (
          SELECT content_id, -1 AS at, count(*) AS delta FROM before GROUP BY content_id
          UNION ALL SELECT old_id, ord, -1 FROM moves UNION ALL SELECT new_id, ord, 1 FROM moves)
        SELECT path, content_id, CASE WHEN held > 0 THEN 'DUPLICATE' ELSE 'ORIGINAL' END AS image_type
        FROM (SELECT z.path, z.content_id, sum(delta) AS held FROM batch z
              LEFT JOIN deltas d ON d.content_id = z.content_id AND d.at < z.ord GROUP BY ALL)""",
    "sync_report": f"""WITH {CHANGES}, scan AS (
          SELECT arg_max(event_type, ord) AS kind,
            epoch_ms(max(ts)) IS NOT DISTINCT FROM epoch_ms(max(ts) FILTER (WHERE value < 100)) AS known
          FROM changes GROUP BY path)
        SELECT count(*) FILTER (WHERE NOT known AND kind <> 'error') AS ingested,
               count(*) FILTER (WHERE known) AS skipped,
               count(*) FILTER (WHERE NOT known AND kind = 'error') AS errors FROM scan""",
    "near_dup_match": f"WITH {PICTURES}, {NEAREST} SELECT id, matched_id, distance FROM matched",
    "near_dup_stored": NEAR_STORED,
    "near_dup_indexed": NEAR_STORED,
    "dup_groups": f"WITH RECURSIVE {PICTURES}, {NEAREST}, {WALK}",
    "dup_groups_incremental": f"""WITH RECURSIVE {PICTURES},
        per_sha AS MATERIALIZED (
          SELECT min(l.doc_id) AS stored_id, min(p.doc_id) AS first_id, min(b) AS b
          FROM pictures p LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY sha),
        arrivals AS MATERIALIZED (SELECT coalesce(stored_id, first_id + 1000000000000) AS id, b FROM per_sha),
        nodes AS (SELECT b, min(id) AS o FROM arrivals GROUP BY b),
        near AS (SELECT x.id, n.b, n.o, bit_count(xor(x.b, n.b)) AS d FROM arrivals x JOIN nodes n
                 ON x.id >= 1000000000000 AND n.o < x.id AND bit_count(xor(x.b, n.b)) <= 5),
        best AS (SELECT id, arg_min(b, d::HUGEINT * 10000000000000 + o) AS b, min(d) AS d FROM near GROUP BY id),
        matched AS MATERIALIZED (
          SELECT best.id, max(c.id) AS matched_id, CAST(min(best.d) AS INTEGER) AS distance
          FROM best JOIN arrivals c ON c.b = best.b AND c.id < best.id GROUP BY best.id),
        {WALK}""",
    "near_dup_discard": f"""WITH RECURSIVE {PICTURES},
        queue AS MATERIALIZED (
          SELECT row_number() OVER (ORDER BY min(id)) AS n, min(id) AS id, b FROM contents GROUP BY b),
        walk(n, kept) AS (
          SELECT 0::BIGINT, []::UBIGINT[] UNION ALL
          SELECT q.n, CASE WHEN len(list_filter(kept, lambda k: bit_count(xor(k, q.b)) <= 5)) > 0 THEN kept
                      ELSE list_append(kept, q.b) END
          FROM walk w JOIN queue q ON q.n = w.n + 1),
        kept AS MATERIALIZED (
          SELECT q.id, q.b FROM queue q JOIN (
            SELECT unnest((SELECT kept FROM walk ORDER BY n DESC LIMIT 1)) AS b) USING (b)),
        others AS (SELECT doc_id, b FROM pictures WHERE sha NOT IN
          (SELECT p.sha FROM pictures p JOIN kept k ON k.id = p.doc_id))
        SELECT doc_id, arg_min(k.id, bit_count(xor(o.b, k.b))::BIGINT * 1000000000 + k.id) AS content_id,
               CAST(min(bit_count(xor(o.b, k.b))) AS INTEGER) AS distance
        FROM others o JOIN kept k ON k.id < o.doc_id AND bit_count(xor(o.b, k.b)) <= 5 GROUP BY doc_id""",
    "compare_folders": f"""WITH {PICTURES} SELECT doc_id FROM pictures a WHERE lang = 'en'
        AND sha NOT IN (SELECT sha FROM pictures WHERE lang <> 'en')
        AND NOT EXISTS (SELECT 1 FROM pictures b WHERE b.lang <> 'en' AND bit_count(xor(a.b, b.b)) <= 5)""",
    "resolve_folder": f"""WITH {FOLDERS}, named AS (SELECT path, row_number() OVER (ORDER BY path) AS id FROM folders)
        SELECT page_id, arg_max(id, length(path)) AS parent_folder_id
        FROM pages LEFT JOIN named ON starts_with(url, path) GROUP BY page_id""",
    "upsert_folders": f"""WITH {FOLDERS}, named AS (
          SELECT path, path LIKE 'https:%' AS known,
            row_number() OVER (PARTITION BY path LIKE 'https:%' ORDER BY path) AS n FROM folders)
        SELECT CASE WHEN known THEN n ELSE n + (SELECT count(*) FROM named WHERE known) END AS id,
          path AS parent_folder_path,
          CASE WHEN known THEN 'known' ELSE regexp_extract(path, '([^/]*)$', 1) END AS title FROM named""",
    "library_stats": f"""WITH {STORE}, {PER_CONTENT} SELECT
        (SELECT count(*) FROM content) AS total_content, (SELECT count(*) FROM files) AS total_files,
        (SELECT count(*) FROM files WHERE image_type IN ('DUPLICATE', 'SIMILAR')) AS dupes,
        CAST((SELECT coalesce(sum(uploaded_bytes), 0) FROM content WHERE status = 'INDEXED') AS BIGINT) AS stored_bytes,
        CAST((SELECT coalesce(sum(bytes), 0) FROM per_content WHERE copies > 0) AS BIGINT) AS saved_bytes,
        (SELECT count(*) FROM content WHERE dup_group IS NOT NULL) AS near_dup_count,
        (SELECT count(*) FROM content WHERE status = 'INDEXED') AS indexed""",
    "saved_bytes": f"""WITH {STORE}, {PER_CONTENT}
        SELECT CAST(coalesce(sum(CASE WHEN copies > 0 THEN bytes END), 0) AS BIGINT) AS saved_bytes FROM per_content""",
    "library_stats_ext": """SELECT strftime((SELECT max(o_orderdate) FROM orders), '%Y-%m-%d') AS last_upload,
        CAST((SELECT sum(len(embedding) * 4) FROM embeddings) AS BIGINT) AS index_bytes""",
    "status_rollup": """WITH s AS (SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN 'PENDING'
            WHEN '2-HIGH' THEN 'UPLOADING' WHEN '3-MEDIUM' THEN 'ERROR' WHEN '5-LOW' THEN 'INDEXED'
            ELSE 'UPLOADED' END AS a FROM orders),
        u AS (SELECT *, CASE WHEN a IN ('PENDING', 'UPLOADING', 'ERROR')
            THEN CASE WHEN o_orderstatus <> 'P' THEN 'UPLOADED' ELSE 'UPLOADING' END ELSE a END AS b FROM s)
        SELECT CASE WHEN b IN ('UPLOADED', 'INDEXING', 'INDEXED', 'ERROR') AND o_orderstatus = 'O'
            THEN CASE WHEN o_totalprice > 100000 THEN 'INDEXED' ELSE 'ERROR' END ELSE b END AS status,
          count(*) AS contents FROM u GROUP BY 1""",
    "check_violations": """SELECT o_orderkey AS id, 'status not null' AS rule FROM orders WHERE o_orderstatus = 'P'
        UNION ALL SELECT o_orderkey, 'status domain' FROM orders WHERE o_orderstatus = 'F'
        UNION ALL SELECT o_orderkey, 'total_size not null' FROM orders WHERE o_orderpriority = '5-LOW'""",
    "unique_violations": """SELECT sha256(text) AS value, count(*) AS copies FROM documents
        GROUP BY 1 HAVING count(*) > 1""",
    "fk_violations": """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
        WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')""",
    "fk_set_null": """SELECT o_orderkey AS l_orderkey, l_linenumber, l_partkey FROM lineitem
        LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') ON o_orderkey = l_orderkey""",
    "chunk_plan": f"WITH {PARTS} SELECT upload_row_id, part_number, part_offset, part_size FROM plan",
    "chunk_pending": f"""WITH {PARTS} SELECT upload_row_id, part_number, part_size, ledger_id
        FROM plan LEFT JOIN ledger USING (upload_row_id, part_number) WHERE NOT coalesce(done, false)""",
    "chunk_manifest": f"""WITH {PARTS} SELECT upload_row_id, count(*) AS parts,
          string_agg(part_number || ':' || etag, ',' ORDER BY part_number) AS manifest
        FROM plan LEFT JOIN ledger USING (upload_row_id, part_number)
        GROUP BY upload_row_id HAVING bool_and(coalesce(done, false))""",
    "resume_decision": f"""WITH {PARTS}, chosen AS (
          SELECT * FROM uploads WHERE initiated_at > TIMESTAMP '2001-08-02' - INTERVAL 7 DAY
          QUALIFY row_number() OVER (PARTITION BY content_id ORDER BY id) = 1),
        decided AS (SELECT c_custkey AS content_id, id, upload_id,
          CASE WHEN id IS NULL THEN 'fresh' WHEN status = 'UPLOADED' THEN 'done' WHEN upload_id IS NULL THEN 'fresh'
               ELSE 'resume' END AS decision
          FROM customer LEFT JOIN chosen ON content_id = c_custkey)
        SELECT content_id, decision, CASE WHEN decision <> 'fresh' THEN id END AS upload_row_id,
          CASE WHEN decision <> 'fresh' THEN upload_id END AS upload_id FROM decided""",
    "reconcile_uploads": f"""WITH {PARTS}, listed AS (
          SELECT DISTINCT 'u' || l_orderkey AS upload_id FROM lineitem WHERE l_returnflag = 'R')
        SELECT coalesce(a.upload_id, b.upload_id) AS upload_id, b.id AS upload_row_id,
          CASE WHEN b.id IS NULL THEN 'abort' WHEN b.status = 'UPLOADED' THEN 'none'
               WHEN a.upload_id IS NULL THEN 'restart' ELSE 'resume' END AS action
        FROM listed a FULL JOIN (SELECT * FROM uploads WHERE upload_id IS NOT NULL) b ON a.upload_id = b.upload_id""",
    "search_topk": f"WITH {SCORED} SELECT round(s, 4) AS score, id, s3_path FROM found",
    "search_lines": f"WITH {SCORED} SELECT printf('%.2f %d %s', s, id, s3_path) AS line FROM found",
    "search_batch": """WITH xs AS (
          SELECT label, unnest(range(len(embedding))) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings),
        means AS (SELECT label, list(m ORDER BY pos) AS q
                  FROM (SELECT label, pos, avg(x) AS m FROM xs GROUP BY ALL) GROUP BY label),
        scored AS (SELECT m.label, vec_id, list_cosine_similarity(embedding::DOUBLE[], q) AS s FROM embeddings, means m)
        SELECT label::BIGINT AS query_id, round(s, 4) AS score, vec_id AS id, 'photos/' || vec_id AS s3_path
        FROM (SELECT * FROM scored
              QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(s, 9) DESC, vec_id) <= 20)
        WHERE s >= 0.22""",
    "more_like_this": """SELECT round(s, 4) AS score, id, s3_path FROM (
          SELECT e.vec_id AS id, 'photos/' || e.vec_id AS s3_path,
            list_cosine_similarity(e.embedding::DOUBLE[], o.embedding::DOUBLE[]) AS s
          FROM embeddings e, embeddings o WHERE o.vec_id = 0 AND e.vec_id <> 0
          ORDER BY round(s, 9) DESC, id LIMIT 20)""",
    "embed_queries": """WITH codes AS (
          SELECT item_id, unicode(unnest(regexp_extract_all(text, '(?s).'))) % 64 AS pos FROM benchmark),
        counts AS (SELECT item_id, pos, count(*)::DOUBLE AS n FROM codes GROUP BY ALL),
        full_counts AS (
          SELECT item_id, list(coalesce(n, 0.0) ORDER BY pos) AS q
          FROM (SELECT item_id, unnest(range(64)) AS pos FROM benchmark) LEFT JOIN counts USING (item_id, pos)
          GROUP BY item_id),
        scored AS (SELECT item_id, vec_id, list_cosine_similarity(embedding::DOUBLE[], q) AS s
                   FROM embeddings, full_counts)
        SELECT item_id AS query_id, round(s, 4) AS score, vec_id AS id, 'photos/' || vec_id AS s3_path
        FROM scored QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(s, 9) DESC, vec_id) <= 20""",
    "embed_update": f"""WITH {LABELLED} SELECT id,
          CASE WHEN status = 'INDEXED' AND embedding IS NOT NULL THEN 'INDEXED'
               WHEN length(text) >= 1000 THEN 'INDEXED' ELSE 'ERROR' END AS status,
          round(CASE WHEN NOT (status = 'INDEXED' AND embedding IS NOT NULL) AND length(text) >= 1000
                THEN length(text)::DOUBLE ELSE list_sum(embedding::DOUBLE[]) END, 2) AS vector_sum FROM labelled""",
    "embed_images": """SELECT doc_id, CAST(len(list_distinct(list_transform(
          regexp_extract_all(text, '(?s).'), lambda c: unicode(c) % 64))) AS INTEGER) AS dimensions,
          false AS failed FROM documents""",
    "stream_dedup": f"WITH {CHANGES} SELECT DISTINCT path, epoch_us(ts) AS mtime_us FROM changes",
    "stream_changes": f"""WITH {CHANGES} SELECT path, ord AS event_id, file_size FROM changes
        QUALIFY row_number() OVER (PARTITION BY path ORDER BY ts DESC, ord DESC) = 1""",
}
