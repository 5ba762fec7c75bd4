"""The classification rules as plain SQL, for comparison: written from the rules, not from the DataFrame code."""

from __future__ import annotations

import re

from specimatrix.functions.phrases import DICTIONARY, MITOCHONDRIAL, NUCLEAR

LENGTH = "CAST(floor(TRY_CAST(trim(regexp_replace(seq_length, '\\s*bp\\s*', '', 'g')) AS DOUBLE)) AS INTEGER)"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def phrase_regex(gene: str) -> str:
    parts = []
    for p in dict.fromkeys(x.lower() for x in DICTIONARY[gene]):
        right = r"\b" if re.match(r"\w", p[-1]) else r"(?:\s|$)"
        parts.append(r"\b" + re.escape(p).replace("\\ ", " ").replace("\\-", "-") + right)
    return "|".join(parts)


def name(gene: str) -> str:
    return "h_" + re.sub(r"\W", "_", gene)


def base(table: str = "final") -> str:
    """Records with what the rules look at: d, n, mito, and a hit column per marker."""
    hits = ", ".join(f"regexp_matches(d, {quoted(phrase_regex(g))}) AS {name(g)}" for g in DICTIONARY)
    return f"""kept AS (SELECT * FROM {table} WHERE {LENGTH} BETWEEN 150 AND 50000),
firsts AS (SELECT min(row_id) AS row_id FROM kept GROUP BY locusid),
b0 AS (SELECT k.*, trim(lower(coalesce(definition, ''))) AS d, coalesce({LENGTH}, 0) AS n, trim(lower(coalesce(organelle, ''))) AS org, lower(trim(coalesce(moleculetype, ''))) AS mol, lower(trim(coalesce(topology, ''))) AS top, coalesce(pcr_primers, '') AS pcr FROM kept k JOIN firsts USING (row_id)),
b AS (SELECT *, org LIKE '%mitochondrion%' AS mito, {hits} FROM b0)"""


def compact(items: list[str]) -> str:
    return "list_filter([" + ", ".join(items) + "], lambda x: x IS NOT NULL)"


def first_round() -> str:
    """CTEs ending in r1: row_id and the six diagnostics of the first round."""
    others = lambda genes, first: [g for g in sorted(genes) if g not in first]
    mt, nt = others(MITOCHONDRIAL, ("mtgenome",)), others(NUCLEAR, ("18-28s", "its1-its2"))
    hit = lambda g: f"CASE WHEN {name(g)} THEN {quoted(g)} END"
    note = lambda g: f"CASE WHEN {name(g)} THEN {quoted(g + ': keyword matched (no length filter)')} END"
    short = "CASE WHEN h_mtgenome AND n = 3000 THEN 'mtgenome: keyword matched but Length=' || n || '<=3000' WHEN h_mtgenome AND n < 3000 THEN 'mtgenome: keyword matched but length ' || n || ' outside range 3000:500000' END"
    cluster = "CASE WHEN h_18_28s AND n NOT BETWEEN 5000 AND 15000 THEN '18-28s: keyword matched but length ' || n || ' outside range 5000:15000' END"
    told = lambda t: "[" + t + "]"
    return f"""{base()},
m AS (SELECT *,
  CASE WHEN mito AND h_mtgenome AND n BETWEEN 3001 AND 500000 THEN ['mtgenome']
       WHEN mito THEN {compact([hit(g) for g in mt])}
       WHEN h_18_28s AND n BETWEEN 5000 AND 15000 THEN ['18-28s']
       WHEN h_its1_its2 THEN ['its1-its2']
       ELSE {compact([hit(g) for g in nt])} END AS genes,
  CASE WHEN mito AND h_mtgenome AND n BETWEEN 3001 AND 500000 THEN ['mtgenome: priority match hit']
       WHEN mito THEN {compact([short] + [note(g) for g in mt])}
       WHEN h_18_28s AND n BETWEEN 5000 AND 15000 THEN ['18-28s: priority match hit']
       WHEN h_its1_its2 THEN {compact([cluster, quoted('its1-its2: priority match hit')])}
       ELSE {compact([cluster] + [note(g) for g in nt])} END AS notes FROM b),
c AS (SELECT *, array_to_string(list_sort(genes), ',') AS g1, len(genes) AS k,
  list_has_any(genes, ['mtgenome', '18-28s', 'its1-its2']) AS special,
  CASE WHEN d LIKE '%trna%' THEN 'tRNA' WHEN d LIKE '%complete sequence%' THEN 'complete sequence' END AS trig,
  CASE WHEN list_contains(genes, '12s') AND d LIKE '%large subunit ribosomal%' THEN '12s'
       WHEN list_contains(genes, '16s') AND d LIKE '%small subunit ribosomal%' THEN '16s'
       WHEN list_contains(genes, '18s') AND d LIKE '%mitochondrial%' THEN '18s'
       WHEN list_contains(genes, '28s') AND d LIKE '%mitochondrial%' THEN '28s' END AS rib FROM m),
e AS (SELECT *, CASE WHEN special THEN 'special' WHEN mito AND k > 2 AND n > 3000 THEN 'genome' WHEN mito AND k > 2 THEN 'many' WHEN mito AND k = 2 AND trig IS NOT NULL THEN 'dual' WHEN rib IS NOT NULL THEN 'rib' ELSE 'none' END AS verdict FROM c),
f AS (SELECT *, CASE verdict WHEN 'genome' THEN 'mtgenome' WHEN 'rib' THEN rib ELSE g1 END AS g2,
  CASE verdict WHEN 'special' THEN 'Special type (mtgenome/18-28s/its1-its2), skip conflict check'
    WHEN 'genome' THEN 'Mitochondrial multi-match (' || k || ') + Length>3000 -> reassigned to mtgenome'
    WHEN 'many' THEN 'Mitochondrial multi-match but insufficient length, kept original + flagged'
    WHEN 'dual' THEN 'Dual match + ''' || trig || ''' in definition, kept original + flagged'
    WHEN 'rib' THEN CASE WHEN rib = '12s' THEN '12s matched with ''large subunit ribosomal'' in definition, possible 16S mismatch, flagged'
      WHEN rib = '16s' THEN '16s matched with ''small subunit ribosomal'' in definition, possible 12S mismatch, flagged'
      WHEN n > 800 THEN rib || ' in definition with ''mitochondrial'' but length ' || n || '>800, kept ' || rib
      ELSE rib || ' in definition with ''mitochondrial'' and length ' || n || '<=800, flagged as uncertain' END END AS note2,
  CASE verdict WHEN 'many' THEN 'Mitochondrial multi-match (' || k || ') but length ' || n || '<3000'
    WHEN 'dual' THEN 'Two mitochondrial genes + definition contains ''' || trig || ''''
    WHEN 'rib' THEN CASE WHEN rib = '12s' THEN '12s conflicts with ''large subunit ribosomal'' description'
      WHEN rib = '16s' THEN '16s conflicts with ''small subunit ribosomal'' description'
      WHEN n > 800 THEN rib || ' conflicts with mitochondrial annotation'
      ELSE rib || ' conflicts with mitochondrial annotation, short length' END
    WHEN 'none' THEN CASE WHEN k > 1 THEN 'Multiple candidate gene types: ' || replace(g1, ',', ', ') END END AS why FROM e),
r1 AS (SELECT row_id, CASE WHEN k > 0 THEN g2 ELSE '' END AS gene_type,
  CASE WHEN k = 0 THEN '' WHEN g2 <> g1 THEN 'first_match -> conflict_check' ELSE 'first_match' END AS match_source,
  g1 AS original_match, k > 0 AND why IS NOT NULL AS has_conflict, CASE WHEN k > 0 THEN coalesce(why, '') ELSE '' END AS conflict_reason,
  concat_ws('; ', CASE WHEN len(notes) > 0 THEN array_to_string(notes, '; ') END,
    CASE WHEN k > 0 AND (note2 IS NOT NULL OR (verdict = 'none' AND k > 1) OR g2 <> g1) THEN '[conflict check] ' || concat_ws('; ', note2, CASE WHEN verdict = 'none' AND k > 1 THEN 'Multiple candidates flagged as conflict' END, CASE WHEN g2 <> g1 THEN 'Reassigned: [' || g1 || '] -> [' || g2 || ']' END) END) AS assignment_reason
  FROM f)"""


def second_round() -> str:
    """``first_round`` and then r2: what the second look gives the leftovers."""
    listed = list(DICTIONARY)
    whole = "(h_mtgenome AND n > 3000 AND mol = 'dna' AND (in_d OR in_o))"
    hit = lambda g: f"CASE WHEN {whole if g == 'mtgenome' else name(g)} THEN {quoted(g)} END"
    note = lambda g: f"CASE WHEN {whole if g == 'mtgenome' else name(g)} THEN {quoted('mtgenome: keyword + Length>3000 + DNA + mitochondrial features' if g == 'mtgenome' else g + ': keyword matched')} END"
    names = lambda genes: ", ".join(map(quoted, genes))
    flag = lambda c: f"CASE WHEN {c} THEN 'True' ELSE 'False' END"
    return f"""{first_round()},
s0 AS (SELECT f.*, regexp_matches(d, 'mitochondri(on|al|a)') AS in_d, regexp_matches(org, 'mitochondri(on|al|a)') AS in_o FROM f WHERE k = 0),
s1 AS (SELECT *, top = 'circular' AS circ, {compact([hit(g) for g in listed])} AS byg, {compact([note(g) for g in listed])} AS bynote,
  regexp_matches(pcr, '(?i)(fwd|rev)_name:\\s*(HCO2198|lc01490|LCO1490)') AS p_coi, regexp_matches(pcr, '(?i)(fwd|rev)_name:\\s*28SC1') AS p_28 FROM s0),
s2 AS (SELECT *, CASE WHEN circ THEN ['mtgenome'] WHEN len(byg) > 0 THEN list_sort(byg) ELSE {compact(["CASE WHEN p_28 THEN '28s' END", "CASE WHEN p_coi THEN 'coi' END"])} END AS g3,
  CASE WHEN circ THEN ['Topology=circular -> direct mtgenome'] WHEN len(byg) > 0 THEN bynote ELSE {compact(["CASE WHEN p_coi THEN 'PCR primer match (HCO2198/lc01490) -> coi' END", "CASE WHEN p_28 THEN 'PCR primer match (28SC1) -> 28s' END"])} END AS n3 FROM s1),
s3 AS (SELECT *, {compact([
    f"CASE WHEN NOT circ AND h_mtgenome AND NOT {whole} THEN 'mtgenome: conditions not met (Length=' || n || ', MoleculeType=' || mol || ', mito_in_def=' || {flag('in_d')} || ', mito_in_org=' || {flag('in_o')} || ')' END",
    "CASE WHEN len(g3) > 1 THEN 'Multiple candidates: ' || array_to_string(g3, ', ') END",
    f"CASE WHEN len(g3) = 1 AND g3[1] IN ({names(MITOCHONDRIAL)}) AND NOT (in_d OR in_o) THEN 'Mitochondrial candidate (' || g3[1] || ') but no mitochondrial marker in organelle/definition' END",
    f"CASE WHEN len(g3) = 1 AND g3[1] IN ({names(NUCLEAR)}) AND (in_d OR in_o) THEN 'Nuclear candidate (' || g3[1] || ') but mitochondrial marker in organelle/definition' END",
])} AS against FROM s2),
r2 AS (SELECT row_id, array_to_string(g3, ',') AS gene_type, CASE WHEN len(g3) > 0 THEN 'recheck_mode' ELSE '' END AS match_source, array_to_string(g3, ',') AS original_match,
  len(against) > 0 AND len(g3) > 0 AS has_conflict, CASE WHEN len(against) > 0 AND len(g3) > 0 THEN array_to_string(against, '; ') ELSE '' END AS conflict_reason, array_to_string(n3, '; ') AS assignment_reason FROM s3)"""
