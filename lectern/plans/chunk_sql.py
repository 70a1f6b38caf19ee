"""DuckDB SQL of its own for chunks of texts and for the hash embedder, from which other queries' SQL is made.

Chunks: a text is split before its widest separator; pieces that are too long are split again by the next one
they hold. Pieces short enough, one after another under one parent, are a run, and a run is cut into windows:
each as long as it may be, the next one starting at the first piece that keeps the overlap and leaves room.
"""

#: Characters of white space at the ends of a chunk.
WHITE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def chunks(rows: str) -> str:
    """CTEs (for ``WITH RECURSIVE``) that end in ``chunk (key, chunk_index, document)``, of ``rows (key, text)``."""
    separator = "[chr(10) || chr(10), chr(10), ' ', '']"
    first = f"(list_filter(range(j + 1, 5), lambda k: k = 4 OR contains(text, {separator}[k]))[1])"
    return rf"""
cut_text AS (SELECT key, text FROM ({rows}) WHERE regexp_matches(text, '[^' || '{WHITE[1:-1]}' || ']')),
cut_node AS (
  SELECT key, []::INT[] AS path, text, 0::BIGINT AS j FROM cut_text
  UNION ALL
  SELECT key, list_append(path, i::INT), piece, k FROM (
    SELECT key, path, k, i, CASE WHEN i > 1 THEN {separator}[k] ELSE '' END || parts[i] AS piece FROM (
      SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT key, path, {first} AS k, string_split(text, {separator}[k]) AS parts FROM cut_node WHERE {first} < 4)))
  WHERE length(piece) >= 1000),
cut_part AS (SELECT key, path, i, piece FROM (
    SELECT key, path, i, CASE WHEN k = 4 THEN parts[i] ELSE CASE WHEN i > 1 THEN {separator}[k] ELSE '' END || parts[i] END AS piece FROM (
      SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM (
        SELECT key, path, {first} AS k, CASE WHEN k < 4 THEN string_split(text, {separator}[k]) ELSE list_transform(range(1, length(text) + 1), lambda c: text[c:c]) END AS parts FROM cut_node)))
  WHERE piece <> ''),
cut_run AS (SELECT key, min(list_append(path, i::INT)) AS place, list(piece ORDER BY i) AS pieces, list(length(piece) ORDER BY i) AS sizes FROM (
    SELECT *, count(*) FILTER (length(piece) >= 1000) OVER (PARTITION BY key, path ORDER BY i) AS run FROM cut_part) WHERE length(piece) < 1000 GROUP BY key, path, run),
cut_sum AS (SELECT key, place, list_prepend(0::BIGINT, list(total ORDER BY i)) AS ends, len(list(total)) AS n FROM (
    SELECT key, place, i, (sum(size) OVER (PARTITION BY key, place ORDER BY i))::BIGINT AS total FROM (SELECT key, place, unnest(sizes) AS size, generate_subscripts(sizes, 1) AS i FROM cut_run)) GROUP BY key, place),
cut_window AS (
  SELECT key, place, 0::BIGINT AS a, (len(list_filter(ends, lambda e: e <= 1000)) - 1)::BIGINT AS b FROM cut_sum
  UNION ALL
  SELECT key, place, next, (len(list_filter(ends, lambda e: e <= ends[next + 1] + 1000)) - 1)::BIGINT FROM (
    SELECT w.key, w.place, s.ends, list_filter(range(w.a, w.b + 1), lambda k: s.ends[w.b + 1] - s.ends[k + 1] <= 200 AND (k = w.b OR s.ends[w.b + 2] - s.ends[k + 1] <= 1000))[1] AS next
    FROM cut_window w JOIN cut_sum s ON s.key = w.key AND s.place = w.place WHERE w.b < s.n)),
cut_said AS (SELECT w.key, w.place, w.a, regexp_replace(array_to_string(r.pieces[w.a + 1:w.b], ''), '^{WHITE}+|{WHITE}+$', '', 'g') AS document FROM cut_window w JOIN cut_run r ON r.key = w.key AND r.place = w.place),
chunk AS (SELECT key, (row_number() OVER (PARTITION BY key ORDER BY place, a) - 1)::INT AS chunk_index, document FROM cut_said WHERE document <> '')"""


def vector(text: str, dimension: int, salt: str = "document") -> str:
    """The hash embedder's unit vector, as FLOAT[]: bytes of chained SHA-256 blocks over 255, less a half."""
    seed = f"unhex(sha256('{salt}' || {text}))"
    blocks = " || ".join(f"sha256({seed} || '\\x00\\x00\\x00\\x{k:02X}'::BLOB)" for k in range(-(-dimension // 32)))
    raw = f"list_transform(range({dimension}), lambda i: ('0x' || substr(hexes, 2 * i + 1, 2))::INT / 255::DOUBLE - 0.5::DOUBLE)"
    return f"(SELECT list_transform(raw, lambda x: (x / norm)::FLOAT) FROM (SELECT raw, sqrt(list_sum(list_transform(raw, lambda x: x * x))) AS norm FROM (SELECT {raw} AS raw FROM (SELECT {blocks} AS hexes))))"
