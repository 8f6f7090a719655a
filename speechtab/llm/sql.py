"""The operators in DuckDB SQL, where it can express them."""

from __future__ import annotations

from speechtab.llm import chat_format, collocations


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _chats() -> str:
    """Formatted lengths follow from the escaped texts: a text that needs no escape is its own."""
    def escaped(column: str) -> str:
        for first, rests in chat_format._RESTS.items():
            pattern = "\\" + first + r"(\\*(?:" + rests + "))"
            column = f"regexp_replace({column}, {_literal(pattern)}, {_literal(first + chr(92) * 2 + chr(92) + '1')}, 'g')"
        return column

    marks = " ".join(
        f"WHEN {_literal(role)} THEN {sum(map(len, pair))}" for role, pair in chat_format.FIELDS.items()
    )
    others = sum(map(len, (*chat_format.NAME_FIELD, *chat_format.TEXT_FIELD)))
    roles = ", ".join(map(_literal, chat_format.FIELDS))
    said = _literal("</s>[INST] ok [/INST]")
    return f"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', {said} UNION ALL SELECT -1, 1, 'assistant', {said}
    ), written AS (
        SELECT *, length({escaped('text')}) + CASE role {marks} ELSE {others} + length({escaped('role')}) END AS size,
            CASE WHEN role = {_literal(chat_format.LOSS_ROLE)} THEN text ELSE '' END AS learnt
        FROM turns
    )
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
        CAST(sum(length(learnt)) AS BIGINT) AS loss_chars,
        sha256(string_agg(learnt, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
        CAST(sum(size) + {len(chat_format.START)} AS BIGINT) AS formatted_chars
    FROM written GROUP BY conv_id
    """


def _collocations() -> str:
    grams = " UNION ALL ".join(
        f"SELECT lang, array_to_string(list_slice(words, i, i + {n - 1}), ' ') AS phrase, {n} AS size "
        f"FROM pieces, unnest(generate_series(1, len(words) - {n - 1})) AS t(i)"
        for n in range(1, collocations.LONGEST + 1)
    )
    return f"""
    WITH pieces AS (
        SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS words FROM (
            SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[.,;:!?\n-\r]'
            )) AS piece FROM documents
        )
    ), known AS (
        SELECT lang, phrase, size, count(*) AS f FROM ({grams}) GROUP BY ALL HAVING count(*) >= {collocations.THRESHOLD}
    ), candidates AS (
        SELECT *, string_split(phrase, ' ') AS words FROM known WHERE size > 1
    ), cuts AS (
        SELECT lang, phrase, f, k, array_to_string(words[1:k], ' ') AS head, array_to_string(words[k + 1:], ' ') AS rest
        FROM candidates, unnest(generate_series(1, size - 1)) AS t(k)
    ), scored AS (
        SELECT lang, phrase, f AS a, arg_min((l, r, s), (s, k)) AS least FROM (
            SELECT c.*, l.f AS l, r.f AS r, CAST({collocations.SCALE}::HUGEINT * c.f // (l.f + r.f) AS BIGINT) AS s
            FROM cuts c JOIN known l ON l.lang = c.lang AND l.phrase = c.head
            JOIN known r ON r.lang = c.lang AND r.phrase = c.rest
        ) GROUP BY lang, phrase, f
    ), inside AS (
        SELECT lang, array_to_string(words[i:i + n - 1], ' ') AS phrase, max(f) AS longer
        FROM candidates, unnest(generate_series(2, size - 1)) AS t(n), unnest(generate_series(1, size - n + 1)) AS u(i)
        GROUP BY ALL
    ), ranked AS (
        SELECT s.lang, s.phrase, s.a, least, row_number() OVER (
            PARTITION BY s.lang ORDER BY least[3] DESC, s.a DESC, s.phrase
        ) AS rank
        FROM scored s LEFT JOIN inside i ON i.lang = s.lang AND i.phrase = s.phrase
        WHERE NOT coalesce(100 * i.longer::HUGEINT >= {collocations.COVERED} * s.a::HUGEINT, false)
    )
    SELECT lang, rank, phrase, a, least[1] AS l, least[2] AS r, n, least[3] AS score FROM ranked
    JOIN (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM pieces GROUP BY lang) USING (lang)
    WHERE rank <= {collocations.TOP}
    """


ORACLE_SQL: dict[str, str] = {"op12_chat_format": _chats(), "op13_collocations": _collocations()}
