"""The queries of this subpackage, and their SQL where SQL can express them."""

from pactum.llm.byte_bpe import op8_byte_bpe
from pactum.llm.chat import TRAP, op12_chat
from pactum.llm.embedding_dedup import op5_embedding_dedup
from pactum.llm.html_text import op2_html_text
from pactum.llm.licences import op4_licences
from pactum.llm.merkle import op13_merkle
from pactum.llm.mixing import op9_mixing
from pactum.llm.simhash import op1_simhash
from pactum.llm.spelling import op11_spelling
from pactum.llm.substrings import op6_substrings
from pactum.llm.token_store import op3_token_store
from pactum.llm.topk import op10_topk
from pactum.llm.toxicity import op7_toxicity

QUERIES = {f.__name__: f for f in (op1_simhash, op2_html_text, op3_token_store, op4_licences, op5_embedding_dedup, op6_substrings, op7_toxicity, op8_byte_bpe, op9_mixing, op10_topk, op11_spelling, op12_chat, op13_merkle)}

#: Vectors without null or non-finite components, a row for each component.
_COMPONENTS = "SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE embedding IS NOT NULL AND len([y for y in embedding if y IS NULL OR NOT isfinite(y)]) = 0"


def _crc32(values: str) -> str:
    """The CRC-32 of a list of bytes, bit by bit."""
    step = "list_reduce(range(8), lambda a, k: xor(a >> 1, 3988292384 * (a & 1)), xor(x, CAST(y AS BIGINT)))"
    return f"xor(4294967295, list_reduce({values}, lambda x, y: {step}, CAST(4294967295 AS BIGINT)))"


def _tree(name: str, leaves: str) -> str:
    """Nodes of the trees over leaves(g, i, d, n), by level, and what stands left and right of each leaf's ancestors."""
    return f"""{name} AS (SELECT g, 0 AS lv, i, d, n FROM {leaves} UNION ALL SELECT g, lv + 1, i // 8, sha256(string_agg(d, '' ORDER BY i)), (n + 7) // 8 FROM {name} WHERE n > 1 GROUP BY g, lv, i // 8, n),
{name}_s AS (SELECT l.g, l.i, u.lv, coalesce(string_agg(u.d, '' ORDER BY u.i) FILTER (WHERE u.i < l.i // CAST(8 ** u.lv AS BIGINT)), '') AS a, coalesce(string_agg(u.d, '' ORDER BY u.i) FILTER (WHERE u.i > l.i // CAST(8 ** u.lv AS BIGINT)), '') AS b
FROM {leaves} l JOIN {name} u ON u.g = l.g AND u.n > 1 AND u.i // 8 = l.i // CAST(8 ** (u.lv + 1) AS BIGINT) GROUP BY 1, 2, 3)"""


_FIELDS = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || {0} END"
_LEAF = "sha256(" + " || ".join(_FIELDS.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || {0})"

#: The others hash, encode, learn or iterate by rules that SQL lacks; tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op5_embedding_dedup": f"""WITH RECURSIVE u AS ({_COMPONENTS}), n AS (SELECT vec_id, sqrt(sum(CAST(x AS DOUBLE) * x)) AS n FROM u GROUP BY 1),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.i = b.i AND a.label = b.label AND a.vec_id <> b.vec_id JOIN n p ON p.vec_id = a.vec_id JOIN n q ON q.vec_id = b.vec_id WHERE p.n > 0 AND q.n > 0 GROUP BY 1, 2, p.n, q.n HAVING sum(CAST(a.x AS DOUBLE) * b.x) >= 0.98 * p.n * q.n),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a), c AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1), k AS (SELECT a, count(*) AS n_links FROM l GROUP BY 1)
SELECT c.a AS vec_id, coalesce(n_links, 0) AS n_links, component_id, c.a = component_id AS kept FROM c LEFT JOIN k ON k.a = c.a""",
    "op6_substrings": """WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 34], ' ') AS t FROM s), c AS (SELECT t FROM g GROUP BY t HAVING count(*) > 1),
h AS (SELECT DISTINCT doc_id, i + k AS p FROM g JOIN c USING (t), range(0, 35) AS r(k)), x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
o AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.p) AS kept, count(*) AS n FROM x LEFT JOIN h ON h.doc_id = x.doc_id AND h.p = x.p WHERE h.p IS NULL GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN o ON o.doc_id = d.doc_id""",
    "op10_topk": f"""WITH u AS (SELECT vec_id, i, CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT) AS x FROM ({_COMPONENTS})),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(sum(a.x * b.x) AS BIGINT) AS score FROM u a JOIN u b ON a.i = b.i WHERE a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op11_spelling": f"""WITH RECURSIVE t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents), l AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS c FROM t WHERE length(r) >= 5 GROUP BY 1, 2),
h AS (SELECT r, c, {_crc32("flatten(list_transform(string_split(id || ':' || r, ''), lambda q: CASE WHEN unicode(q) < 128 THEN [unicode(q)] ELSE [195, unicode(q) - 64] END))")} AS h FROM l), v AS (SELECT CASE WHEN h % 97 = 0 THEN substring(r, 1, h % length(r)) || substring(r, h % length(r) + 2) ELSE r END AS word, c FROM h),
w AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM v WHERE length(word) >= 5 GROUP BY 1 HAVING sum(c) >= 3), k AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM w), d AS (SELECT word, n, k, substring(word, 1, k - 1) || substring(word, k + 1) AS x FROM k),
e AS (SELECT a.word, b.word AS near, b.n AS m FROM d a JOIN d b ON a.k = b.k AND a.x = b.x AND a.word <> b.word UNION SELECT d.word, w.word, w.n FROM d JOIN w ON w.word = d.x UNION SELECT w.word, d.word, d.n FROM d JOIN w ON w.word = d.x),
b AS (SELECT word, count(*) AS n_near, max(m) AS m, arg_min(near, (-m, near)) AS near FROM e GROUP BY 1), f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN near END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM w LEFT JOIN b ON b.word = w.word),
r AS (SELECT word, word AS root, 0 AS s FROM f UNION ALL SELECT r.word, f.form, s + 1 FROM r JOIN f ON f.word = r.root AND f.form IS NOT NULL), z AS (SELECT word, arg_max(root, s) AS root FROM r GROUP BY 1) SELECT f.word, form, root, n, n_near, form_n FROM f JOIN z ON z.word = f.word""",
    "op12_chat": f"""WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '{TRAP}' UNION ALL SELECT -7, 1, 'assistant', '{TRAP}'),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM r), b AS (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY k) <> role, true) AS opens FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
CAST(sum(length(text) + len(regexp_extract_all(text, '<(?:/?turn|next)>')) + CASE WHEN opens THEN 16 + length(replace(replace(role, '\\', '\\\\'), chr(10), '\\n')) + len(regexp_extract_all(role, '<(?:/?turn|next)>')) ELSE 8 END) AS BIGINT) AS formatted_chars FROM b GROUP BY conv_id""",
    "op13_merkle": f"""WITH RECURSIVE h AS (SELECT *, {_LEAF.format(_FIELDS.format("text"))} AS leaf, CASE WHEN {_crc32("list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c))")} % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS later FROM documents),
p AS (SELECT *, {_LEAF.format(_FIELDS.format("later"))} AS found, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS d, count(*) OVER (PARTITION BY lang) AS n FROM h), {_tree("lower_", "p")},
sub AS (SELECT 0 AS g, g AS i, d, count(*) OVER () AS n FROM lower_ WHERE n = 1), {_tree("upper_", "sub")}, root AS (SELECT d FROM upper_ WHERE n = 1),
step AS (SELECT g, i, lv, a, b FROM lower__s UNION ALL SELECT p.g, p.i, s.lv + 100, a, b FROM p JOIN upper__s s ON s.i = p.g), ordered AS (SELECT g, i, a, b, row_number() OVER (PARTITION BY g, i ORDER BY lv) AS k FROM step),
fold AS (SELECT g, i, 0 AS k, found AS d FROM p UNION ALL SELECT f.g, f.i, f.k + 1, sha256(a || d || b) FROM fold f JOIN ordered o ON o.g = f.g AND o.i = f.i AND o.k = f.k + 1), folded AS (SELECT g, i, arg_max(d, k) AS d FROM fold GROUP BY 1, 2), proofs AS (SELECT g, i, sha256(string_agg(a || b, '' ORDER BY k)) AS s FROM ordered GROUP BY 1, 2)
SELECT doc_id, leaf, sub.d AS subroot, root.d AS root, coalesce(proofs.s, sha256('')) AS proof_sha256, folded.d AS folded_root, folded.d = root.d AS verified FROM p JOIN sub ON sub.i = p.g CROSS JOIN root JOIN folded ON folded.g = p.g AND folded.i = p.i LEFT JOIN proofs ON proofs.g = p.g AND proofs.i = p.i""",
}
