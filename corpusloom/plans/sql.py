"""The rules as DuckDB expressions, for the queries' SQL."""

from __future__ import annotations

from corpusloom.functions import constants as C


def text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def names(values) -> str:
    return "(" + ", ".join(map(text, values)) + ")"


def has_any(x: str, parts) -> str:
    return "(" + " OR ".join(f"contains(lower({x}), {text(p)})" for p in parts) + ")"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def normal_line(x: str) -> str:
    return strip(rf"regexp_replace(replace({x}, chr(9), ' '), '[ \t]{{2,}}', ' ', 'g')")


def compact(x: str) -> str:
    return rf"regexp_replace({x}, '\s+', '', 'g')"


def tokens(x: str) -> str:
    return rf"regexp_split_to_array({x}, '\s+')"


def page_number(x: str) -> str:
    return rf"regexp_matches({x}, '^(?:[-–—]?\s*\d{{1,4}}\s*[-–—]?|(?i:page\s+\d{{1,4}}|page\s+\d+\s+of\s+\d+))$')"


def artifact(x: str) -> str:
    return rf"({x} IN {names(C.ARTIFACT_LINES)} OR {has_any(x, C.ARTIFACT_PARTS)} OR (length({compact(x)}) >= 6 AND regexp_matches({compact(x)}, '^[\d():,;|./\\]+$')))"


def graphical(x: str) -> str:
    signs = f"'^[{C.DRAWING_SIGNS}]+$'"
    own = f"list_filter({tokens(x)}, lambda t: t <> '')"
    return f"((len({own}) >= 3 AND len(list_filter({own}, lambda t: regexp_matches(t, {signs}))) >= 0.7::DOUBLE * len({own})) OR (length({compact(x)}) >= 8 AND regexp_matches({compact(x)}, {signs})) OR regexp_matches({x}, '^[-_=~•·.]+$'))"


def citation_cluster(x: str) -> str:
    left = rf"regexp_replace(regexp_replace({x}, '{C.CITATION}', '', 'g'), '[,;:.\s]', '', 'g')"
    return f"(len(regexp_extract_all({x}, '{C.CITATION}')) >= 2 AND length({left}) <= 2)"


def url_or_doi(x: str) -> str:
    return rf"regexp_matches({x}, '^(?:https?://\S+|www\.\S+|(?i:(?:doi:\s*)?10\.\d{{4,9}}/\S+))$')"


def correspondence(x: str) -> str:
    return f"regexp_matches({x}, '(?i){C.CORRESPONDENCE}')"


def email(x: str) -> str:
    return f"regexp_matches({x}, '(?i){C.EMAIL}')"


def affiliation(x: str) -> str:
    return "(" + " + ".join(f"contains(lower({x}), {text(t)})::INT" for t in C.AFFILIATION_TERMS) + ")"


def author_names(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{C.AUTHOR_NAME}'))"


def author_list(x: str) -> str:
    marks = f"(length({x}) - length(replace(replace({x}, ';', ''), '·', '')))"
    return f"(({author_names(x)} >= 6 AND ({affiliation(x)} >= 2 OR {marks} >= 4)) OR (length({x}) > 300 AND {author_names(x)} >= 8))"


def numbered_affiliation(x: str) -> str:
    fused = r"'^\d{1,3}[A-Z][a-zA-Z]{2,}(?:,|$)'"
    n = f"len(list_filter({tokens(x)}, lambda t: regexp_matches(t, {fused})))"
    single = f"(regexp_matches({tokens(x)}[1], {fused}) AND NOT regexp_matches({x}, '[{C.MATH_SIGNS}]') AND length({x}) < 250 AND (contains({x}, ',') OR {affiliation(x)} >= 1))"
    return f"CASE WHEN {n} >= 2 THEN {affiliation(x)} >= 1 AND length({x}) <= 500 WHEN {n} = 1 THEN {single} ELSE false END"


def indexed_affiliation(x: str) -> str:
    return rf"(regexp_matches({x}, '^\d{{1,3}}\s+[A-Z][a-zA-Z]') AND NOT regexp_matches({x}, 'https?://') AND {affiliation(x)} >= 1 AND length({x}) <= 300)"


def heading_form(x: str) -> str:
    return f"trim(lower({strip(x)}), ' .:-')"


def heading(x: str) -> str:
    return rf"({heading_form(x)} IN {names(C.SECTION_NAMES)} OR regexp_matches({strip(x)}, '^\d+(?:\.\d+)*\.?\s+\S.{{0,119}}$'))"


def section_name(x: str) -> str:
    title = rf"regexp_extract({strip(x)}, '^\d+(?:\.\d+)*\.?\s+(.+)$', 1)"
    return f"CASE WHEN {heading_form(x)} IN {names(C.SECTION_NAMES)} THEN {heading_form(x)} WHEN {title} <> '' THEN {strip(title)} ELSE {strip(x)} END"


def fuzzy_key(x: str) -> str:
    part = rf"CASE WHEN regexp_matches({strip('p')}, '^\d+$') THEN '#' ELSE {strip('p')} END"
    return f"CASE WHEN contains({x}, '|') THEN array_to_string(list_transform(string_split(lower({x}), '|'), lambda p: {part}), '|') ELSE lower({x}) END"


def noise_category(x: str) -> str:
    return f"""CASE WHEN {url_or_doi(x)} OR {has_any(x, C.PUBLISHER_PARTS)} OR {has_any(x, C.LICENSE_PARTS)} THEN 'publisher_metadata'
  WHEN {page_number(x)} THEN 'other_noise' WHEN {graphical(x)} THEN 'graphics' WHEN {citation_cluster(x)} THEN 'other_noise'
  WHEN {author_list(x)} OR {numbered_affiliation(x)} OR {indexed_affiliation(x)} THEN 'author_blocks' END"""


def ends_block(x: str) -> str:
    return f"({heading(x)} OR NOT ({email(x)} OR {affiliation(x)} >= 1 OR {url_or_doi(x)} OR length({x}) < 100))"


def hyphenation(x: str) -> str:
    line = rf"regexp_replace({{}}, '([A-Za-z])-\n([a-z])', '\1\2', 'g')"
    return rf"regexp_replace({line.format(line.format(x))}, '\b([a-z]{{4,}})-\s+([a-z]{{2,}})\b', '\1\2', 'g')"


def submission(x: str) -> str:
    return rf"regexp_replace({x}, '(?s)\bReceived:\s*\d{{1,2}}\s+\w+\s+\d{{4}}\b.{{0,750}}?.{{0,750}}?[\w.+-]+@[\w-]+\.[\w.-]+', ' ', 'g')"


def blank_lines(x: str) -> str:
    return strip(rf"regexp_replace(regexp_replace({x}, '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


def words(x: str) -> str:
    return rf"len(regexp_extract_all({x}, '[\p{{L}}\p{{N}}_](?:[\p{{L}}\p{{N}}_''-]*[\p{{L}}\p{{N}}_])?'))"


def joined(lines: str) -> str:
    """Wrapped lines of a list joined."""
    new = rf"len(acc) = 0 OR x = '' OR acc[-1] = '' OR {heading('x')} OR {heading('acc[-1]')} OR regexp_matches(acc[-1], '[.:;?!)\]}}]$')"
    return f"list_reduce({lines}, lambda acc, x: CASE WHEN {new} THEN list_append(acc, x) ELSE list_append(acc[1:len(acc)-1], acc[-1] || ' ' || x) END, []::VARCHAR[])"


def statistics(x: str) -> str:
    """Columns characters, words, garbage_ratio of a text."""
    lines = f"list_filter(list_transform(string_split({x}, chr(10)), lambda l: {strip('l')}), lambda l: l <> '')"
    return f"length({x})::BIGINT AS characters, {words(x)}::BIGINT AS words, round(len(list_filter({lines}, lambda l: {graphical('l')} OR {artifact('l')})) / greatest(1, len({lines}))::DOUBLE, 6) AS garbage_ratio"
