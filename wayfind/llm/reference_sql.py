"""DuckDB SQL for the trie of conversations and the manifest: long statements put together from their steps."""

from __future__ import annotations

# The table of the checksum, by its rule; the checksum of a decimal number's text.
CRC_TABLE = """crc AS (
            SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k:
                CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
        )"""


def crc32(number: str) -> str:
    codes = f"list_transform(string_split({number}::VARCHAR, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


TRIE = f"""
        WITH {CRC_TABLE}, placed AS (
            SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos,
                md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS code, strlen(coalesce(text, '')) AS bytes
            FROM conversations WHERE conv_id IS NOT NULL
        ), convs AS (
            SELECT c, {crc32('c')} % 9 AS h FROM (SELECT DISTINCT c FROM placed), crc
        ), rebuilt AS (
            SELECT v.c, 0 AS part, b.pos, b.code, b.bytes FROM convs v JOIN placed b ON b.c = v.c - v.c % 5 AND b.pos < v.h
            UNION ALL SELECT v.c, 1, p.pos, p.code, p.bytes FROM convs v JOIN placed p ON p.c = v.c AND p.pos >= v.h
        ), numbered AS (
            SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS d, code, bytes FROM rebuilt
        ), beginnings AS (
            SELECT c, d, string_agg(code, '') OVER (PARTITION BY c ORDER BY d) AS key, bytes, d = max(d) OVER (PARTITION BY c) AS ends FROM numbered
            UNION ALL SELECT c, 0, '', 0, NOT EXISTS (SELECT 1 FROM rebuilt r WHERE r.c = v.c) FROM convs v
        ), nodes AS (
            SELECT d, key, min(c) AS c, count(*) AS n, any_value(bytes) AS bytes,
                coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '') AS ends FROM beginnings GROUP BY d, key
        ), families AS (
            SELECT *, (SELECT count(*) FROM nodes q WHERE q.d = p.d + 1 AND starts_with(q.key, p.key)) AS children FROM nodes p
        ), totals AS (
            SELECT p.key, count(*) FILTER (q.children = 0) AS leaves, sum((q.n - 1) * q.bytes)::BIGINT AS saved
            FROM families p JOIN families q ON q.d >= p.d AND starts_with(q.key, p.key) GROUP BY p.key
        )
        SELECT f.c AS conv_id, f.d AS depth, up.c AS parent_conv_id, f.n AS n_convs, f.children AS n_children, t.leaves AS n_leaves,
            t.saved AS saved_tokens, sha256(f.ends) AS ends_sha256
        FROM families f JOIN totals t USING (key) LEFT JOIN nodes up ON up.d = f.d - 1 AND starts_with(f.key, up.key)
"""


def _tree(name: str, first: str, levels: int) -> list[str]:
    """Steps that reduce (g, i, h) of ``first`` by sixteens: ``{name}_side_k`` has the siblings, ``{name}_k`` the nodes of level k."""
    steps, now = [], first
    for k in range(levels):
        steps.append(f"""{name}_side_{k} AS (
            SELECT g, i, h, up, CASE WHEN up THEN array_to_string(run[1:i % 16], '') ELSE '' END AS a, CASE WHEN up THEN array_to_string(run[i % 16 + 2:], '') ELSE '' END AS b
            FROM (SELECT g, i, h, count(*) OVER (PARTITION BY g) > 1 AS up,
                list(h) OVER (PARTITION BY g, i // 16 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS run FROM {now})
        )""")
        now = f"{name}_{k + 1}"
        steps.append(f"{now} AS (SELECT g, i // 16 AS i, CASE WHEN bool_or(up) THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h FROM {name}_side_{k} GROUP BY g, i // 16)")
    return steps


def manifest(levels: int = 6) -> str:
    """``levels`` are those of a group's tree and of the groups' tree: 16^levels leaves at most."""
    def sealed(*fields: str) -> str:
        return "sha256(" + " || ".join(f"coalesce(strlen({f}::VARCHAR) || ':' || {f}::VARCHAR, '-')" for f in fields) + ")"

    fields = ("doc_id", "source", "lang", "n_chars")
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [CRC_TABLE, f"""leaves AS (
            SELECT doc_id, coalesce('1' || source, '0') AS g, {sealed(*fields, 'text')} AS h, CASE WHEN {crc32('doc_id')} % 5 = 0 THEN {sealed(*fields, lowered)} END AS changed
            FROM documents, crc
        )""", "numbered AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM leaves)"]
    steps += _tree("inner", "numbered", levels)
    steps.append(f"groups AS (SELECT '' AS g, g AS name, row_number() OVER (ORDER BY g) - 1 AS i, h FROM inner_{levels})")
    steps += _tree("outer", "groups", levels)
    steps.append("fold_0 AS (SELECT n.doc_id, n.h AS leaf, n.g, n.i, o.i AS oi, o.h AS subroot, '' AS proof, coalesce(n.changed, n.h) AS x FROM numbered n JOIN groups o ON o.name = n.g)")
    for k in range(2 * levels):
        side, at, on = (f"inner_side_{k}", "f.i", "s.g = f.g") if k < levels else (f"outer_side_{k - levels}", "f.oi", "s.g = ''")
        shift = 16 ** (k % levels)
        steps.append(f"fold_{k + 1} AS (SELECT f.* REPLACE (f.proof || s.a || s.b AS proof, CASE WHEN s.up THEN sha256(s.a || f.x || s.b) ELSE f.x END AS x) FROM fold_{k} f JOIN {side} s ON {on} AND s.i = {at} // {shift})")
    return "WITH " + ",\n        ".join(steps) + f"""
        SELECT f.doc_id, f.leaf, f.subroot, r.h AS root, sha256(f.proof) AS proof_sha256, f.x AS folded_root, f.x = r.h AS verified
        FROM fold_{2 * levels} f, outer_{levels} r
"""
