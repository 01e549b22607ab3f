"""DuckDB SQL of the chunkers, as folds written by recursion; each takes the rows to cut as a query.

Sentences are parted by U+E000 on the way, which texts are taken not to hold.
"""

from __future__ import annotations

#: What Python's ``str.split`` and ``\s`` take for white space.
SPACE = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = f"[^{SPACE}]+"


def words(text: str) -> str:
    return f"len(regexp_extract_all({text}, '{WORD}'))"


def pieces(rows: str, keys: str, budget: int, overlap: int) -> str:
    """Common tables up to pieces (keys ..., g, pos, piece), in the order (g, pos), of the rows (keys ..., text).

    Sentences that fit are numbered by the run between two that do not. A run is filled from the sums of its words, one
    piece a step; a sentence over the budget is cut at every ``budget`` words.
    """
    return rf"""sized AS (SELECT *, {words("text")} AS n FROM ({rows}) WHERE text IS NOT NULL),
cut AS (SELECT {keys}, string_split(regexp_replace(text, '([.!?:\n])[{SPACE}]+', '\1' || chr(57344), 'g'), chr(57344)) AS s FROM sized WHERE n > {budget}),
sentences AS (SELECT {keys}, i, t, {words("t")} AS c FROM (SELECT {keys}, unnest(s) AS t, generate_subscripts(s, 1) AS i FROM cut)),
marked AS (SELECT *, sum(CASE WHEN c > {budget} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY i) AS longs FROM sentences WHERE c > 0),
runs AS (SELECT {keys}, 2 * longs AS g, list(t ORDER BY i) AS parts, list_prepend(0, list(e ORDER BY i)) AS ends
  FROM (SELECT *, sum(c) OVER (PARTITION BY {keys}, longs ORDER BY i)::BIGINT AS e FROM marked WHERE c <= {budget}) GROUP BY {keys}, longs),
filled AS (SELECT {keys}, g, ends, 0::BIGINT AS lo, len(list_filter(ends, lambda x: x <= {budget})) - 1 AS hi FROM runs
  UNION ALL SELECT {keys}, g, ends, lo, len(list_filter(ends, lambda x: x <= ends[lo + 1] + {budget})) - 1
  FROM (SELECT {keys}, g, ends, CASE WHEN ends[hi + 2] - ends[back + 1] <= {budget} THEN back ELSE hi END AS lo
  FROM (SELECT *, greatest(lo + 1, len(list_filter(ends, lambda x: x < ends[hi + 1] - {overlap}))) AS back FROM filled WHERE hi < len(ends) - 1))),
pieces AS (SELECT {keys}, 0::BIGINT AS g, 0::BIGINT AS pos, text AS piece FROM sized WHERE n BETWEEN 1 AND {budget}
  UNION ALL SELECT {keys}, g, lo, array_to_string(parts[lo + 1:hi], ' ') FROM filled JOIN runs USING ({keys}, g)
  UNION ALL SELECT {keys}, g, pos, array_to_string(w[{budget} * pos + 1:{budget} * pos + {budget}], ' ')
  FROM (SELECT {keys}, g, w, unnest(range((len(w) + {budget} - 1) // {budget})) AS pos FROM (SELECT {keys}, 2 * longs - 1 AS g, regexp_extract_all(t, '{WORD}') AS w FROM marked WHERE c > {budget})))"""


def split(rows: str, keys: str, budget: int, overlap: int) -> str:
    """``budget.split``."""
    return f"""WITH RECURSIVE {pieces(rows, keys, budget, overlap)}
SELECT {keys}, (count(*) OVER (PARTITION BY {keys}))::INTEGER AS total_chunks, (row_number() OVER (PARTITION BY {keys} ORDER BY g, pos) - 1)::INTEGER AS chunk_index, piece AS text FROM pieces"""


def fitted(rows: str, key: str, order: str, budget: int, least: int, overlap: int) -> str:
    """``budget.fitted`` without tables and images: pieces below ``least`` words join what comes before, if both fit."""
    return f"""WITH RECURSIVE {pieces(rows, f"{key}, {order}", budget, overlap)},
every AS (SELECT {key}, {order}, g, pos, piece FROM pieces UNION ALL SELECT {key}, {order}, 0, 0, text FROM sized WHERE n = 0),
listed AS (SELECT {key}, list(piece ORDER BY {order}, g, pos) AS ps, list({words("piece")} ORDER BY {order}, g, pos) AS cs FROM every GROUP BY {key}),
fold AS (SELECT {key}, cs, 1::BIGINT AS i, 0::BIGINT AS run, cs[1]::BIGINT AS held FROM listed
  UNION ALL SELECT {key}, cs, i + 1, CASE WHEN joins THEN run ELSE run + 1 END, CASE WHEN joins THEN held ELSE 0 END + cs[i + 1]
  FROM (SELECT *, cs[i + 1] < {least} AND held + cs[i + 1] <= {budget} AS joins FROM fold WHERE i < len(cs))),
made AS (SELECT {key}, run, string_agg(ps[i], chr(10) ORDER BY i) AS text FROM fold JOIN listed USING ({key}) GROUP BY {key}, run)
SELECT {key}, (row_number() OVER (PARTITION BY {key} ORDER BY run) - 1)::INTEGER AS chunk_index, text FROM made WHERE regexp_matches(text, '{WORD}')"""


def sections(elements: str, key: str, most: int, combine: int) -> str:
    """``sections.sections`` of elements (key, pos, kind, text).

    One fold packs the parts of each section, a second one joins a section of one short chunk to the chunk before it.
    """
    return f"""WITH RECURSIVE numbered AS (SELECT *, sum((kind = 'title')::INTEGER) OVER (PARTITION BY {key} ORDER BY pos) AS section FROM ({elements})),
parts AS (SELECT {key}, section, pos, k, text[{most} * k + 1:{most} * k + {most}] AS part, length(text) <= {most} AS uncut FROM (SELECT *, unnest(range((length(text) + {most} - 1) // {most})) AS k FROM numbered)),
listed AS (SELECT {key}, section, list(part ORDER BY pos, k) AS ps, list(length(part) ORDER BY pos, k) AS cs, list(uncut ORDER BY pos, k) AS us FROM parts GROUP BY {key}, section),
fold AS (SELECT {key}, section, cs, us, 1::BIGINT AS i, 0::BIGINT AS run, cs[1]::BIGINT AS held FROM listed
  UNION ALL SELECT {key}, section, cs, us, i + 1, CASE WHEN joins THEN run ELSE run + 1 END, CASE WHEN joins THEN held + 2 ELSE 0 END + cs[i + 1]
  FROM (SELECT *, held + 2 + cs[i + 1] <= {most} AND (us[i + 1] OR held < {combine}) AS joins FROM fold WHERE i < len(cs))),
packed AS (SELECT {key}, section, run, string_agg(ps[i], chr(10) || chr(10) ORDER BY i) AS text FROM fold JOIN listed USING ({key}, section) GROUP BY {key}, section, run),
single AS (SELECT *, count(*) OVER (PARTITION BY {key}, section) = 1 AND length(text) < {combine} AS short FROM packed),
chunks AS (SELECT {key}, list(text ORDER BY section, run) AS ts, list(length(text) ORDER BY section, run) AS ls, list(short ORDER BY section, run) AS ss FROM single GROUP BY {key}),
again AS (SELECT {key}, ls, ss, 1::BIGINT AS i, 0::BIGINT AS run, ls[1]::BIGINT AS held FROM chunks
  UNION ALL SELECT {key}, ls, ss, i + 1, CASE WHEN joins THEN run ELSE run + 1 END, CASE WHEN joins THEN held + 2 ELSE 0 END + ls[i + 1]
  FROM (SELECT *, ss[i + 1] AND held + 2 + ls[i + 1] <= {most} AS joins FROM again WHERE i < len(ls)))
SELECT {key}, run::INTEGER AS chunk_index, string_agg(ts[i], chr(10) || chr(10) ORDER BY i) AS text FROM again JOIN chunks USING ({key}) GROUP BY {key}, run"""
