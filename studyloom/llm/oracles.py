"""SQL of the text queries that SQL can express: the look of text by translate() with a table written here by hand."""

from __future__ import annotations

# What cannot be seen, blanks, and letters with the Latin letter that looks the same, by character.
_UNSEEN = [0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0xFE00, 0xFE10), 0xFEFF]
_BLANKS = [0x09, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
_LETTERS = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ѵ": "v", "ԁ": "d",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v",
    "μ": "µ", "\u212a": "K", "‐": "-", "‑": "-",
}
# The same for letters stored together with their accent.
_ACCENTED = {
    "ё": "ë", "Ё": "Ë", "ѐ": "è", "Ѐ": "È", "ї": "ï", "Ї": "Ï", "ӓ": "ä", "Ӓ": "Ä", "ӑ": "ă", "Ӑ": "Ă", "ӗ": "ĕ", "Ӗ": "Ĕ", "ӧ": "ö", "Ӧ": "Ö", "ӱ": "ÿ", "ӯ": "ȳ",
    "ό": "ó", "Ό": "Ó", "Ά": "Á", "Έ": "É", "Ί": "Í", "Ύ": "Ý", "Ϊ": "Ï", "Ϋ": "Ÿ",
}
# The small letters whose capital looks like a Latin one.
_SMALL = {"в": "b", "к": "k", "м": "m", "н": "h", "т": "t", "α": "a", "β": "b", "ε": "e", "ζ": "z", "η": "h", "ι": "i", "κ": "k", "ρ": "p", "τ": "t", "υ": "y", "χ": "x"}
_LIGATURES = {"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\ufb05": "st", "\ufb06": "st"}
_WIDE = {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}


def _translate(text: str, of: dict[str, str], gone: list[int] = []) -> str:  # noqa: B006
    quote = lambda s: s.replace("'", "''")
    return f"translate({text}, '{quote(''.join(of) + ''.join(map(chr, gone)))}', '{quote(''.join(of.values()))}')"


def _look(text: str) -> str:
    """SQL: what cannot be seen taken out, line ends, widths, composed form, letters, ligatures, composed form again."""
    x = _translate(text, {chr(p): " " for p in _BLANKS}, _UNSEEN)
    x = _translate(f"replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10))", _WIDE | _LETTERS)
    x = _translate(f"nfc_normalize({x})", _ACCENTED)
    for sign, letters in _LIGATURES.items():
        x = f"replace({x}, '{sign}', '{letters}')"
    return f"nfc_normalize({x})"


def _line_key(line: str) -> str:
    low = _translate(_translate(f"lower({_look(line)})", _LETTERS), _SMALL)
    return rf"regexp_replace(regexp_replace({low}, '\s+', '', 'g'), '[0-9]+', '0', 'g')"


_UUID = "case when length(regexp_replace(lower(document_id), 'urn:uuid:|[^0-9a-f]', '', 'g')) = 32 then regexp_replace(lower(document_id), 'urn:uuid:|[^0-9a-f]', '', 'g') else '!' || trim(lower(document_id)) end"
_REPEATED = f"""
l as (
  select chunk_id, source, doc, n::int as line_no, {_line_key("line")} as k from (
    select chunk_id, source, {_UUID} as doc, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from chunks where text is not null)),
n as (
  select source, count(distinct {_UUID}) as n_docs from chunks where document_id is not null group by 1),
bad as (
  select l.source, l.k from l join n on n.source is not distinct from l.source where k <> '' group by l.source, l.k, n.n_docs having count(distinct doc) >= 4 and count(distinct doc) / n.n_docs >= 0.1),
hit as (
  select distinct l.chunk_id, l.line_no from l join bad on bad.source is not distinct from l.source and bad.k = l.k)
"""
ORACLES = {
    "p1_found": f"""with f as (
        select 'chunks' as table_name, chunk_id as id, text, {_look("text")} as look from chunks where text is not null
        union all select 'document_summaries', summary_id, text, {_look("text")} from document_summaries where text is not null)
      select a.table_name, a.id as id_a, b.id as id_b from f a join f b on a.table_name = b.table_name and a.look = b.look and a.id < b.id and a.text <> b.text""",
    "p2_found": f"with {_REPEATED} select chunk_id, line_no from hit",
    "p2_cleaned": f"""with {_REPEATED},
      gone as (select chunk_id, list(line_no) as g from hit group by 1),
      t as (select c.chunk_id, case when g is null then text else coalesce(array_to_string(list_filter(list_transform(range(1, len(string_split(text, chr(10))) + 1), lambda i: case when list_contains(g, i::int) then null else string_split(text, chr(10))[i] end), lambda x: x is not null), chr(10)), '') end as text
        from chunks c left join gone using (chunk_id))
      select chunk_id, length(text) as n_chars, md5(text) as text_md5 from t""",
}
