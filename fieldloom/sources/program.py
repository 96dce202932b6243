"""Dataset programs: reading, editing and writing the YAML documents that describe how a dataset is harmonised."""

from __future__ import annotations

import csv
import re
from pathlib import Path
from urllib.parse import quote

import yaml

#: Sections of a program, in order.
SECTIONS = ["source", "contributors", "dataset", "identifiers", "locations", "contexts", "traits", "substitutions", "taxonomic_updates", "exclude_observations", "questions"]
#: Fields of a program's dataset section.
DATASET_FIELDS = "data_is_long_format custom_R_code collection_date taxon_name trait_name value location_name individual_id repeat_measurements_id source_id description basis_of_record basis_of_value entity_type value_type life_stage replicates measurement_remarks unit_in plot_context_id sampling_strategy original_file notes".split()
#: Columns of a new, empty taxon list.
TAXON_LIST = "aligned_name taxonomic_dataset aligned_scientific_name_id aligned_name_taxonomic_status aligned_name_alternative_taxonomic_status taxon_name taxon_id scientific_name_authorship taxon_rank taxonomic_status family taxon_distribution establishment_means scientific_name scientific_name_id".split()
MISSING = (".na", ".na.character", "", None)


class _Loader(yaml.SafeLoader):
    """Dates and times stay text."""


_Loader.yaml_implicit_resolvers = {k: [r for r in v if r[0] != "tag:yaml.org,2002:timestamp"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}


def clean(x):
    """The same structure with missing tokens as None; a list of nothing is None."""
    if isinstance(x, dict):
        return {k: clean(v) for k, v in x.items()}
    if isinstance(x, list):
        out = [clean(v) for v in x]
        return None if out == [None] else out
    return None if x in MISSING else x


def read_program(path: str | Path) -> dict:
    """A program; the text of its custom step keeps its lines and indents as they stand in the file."""
    text = Path(path).read_text(encoding="utf-8")
    program = clean(yaml.load(text, _Loader)) or {}
    if (program.get("dataset") or {}).get("custom_R_code") and (m := re.search(r"(?ms)^  custom_R_code:(.*?)(?=^  \w+:)", text)):
        program["dataset"]["custom_R_code"] = m[1].rstrip("\n")
    return program


def write_program(program: dict, path: str | Path) -> None:
    """Writes the sections in their order; what is missing becomes ``.na``."""

    def fill(x):
        if isinstance(x, dict):
            return {k: fill(v) for k, v in x.items()}
        if isinstance(x, list):
            return [fill(v) for v in x]
        return ".na" if x is None else x

    ordered = {k: fill(program[k]) for k in [*SECTIONS, *[k for k in program if k not in SECTIONS]] if k in program}
    Path(path).write_text(yaml.safe_dump(ordered, sort_keys=False, allow_unicode=True), encoding="utf-8")


def template(dataset_id: str, columns: list[str], answers: dict | None = None) -> dict:
    """A program to fill in: ``unknown`` where a text is needed, and scripted answers for dataset fields."""
    answers = answers or {}
    dataset = {"data_is_long_format": bool(answers.get("data_is_long_format", False)), "custom_R_code": None}
    for name in ["collection_date", "taxon_name", "location_name", "individual_id", "trait_name", "value", "description", "basis_of_record", "life_stage", "sampling_strategy", "original_file", "notes"]:
        if name in answers or name not in ("location_name", "individual_id", "trait_name", "value"):
            dataset[name] = answers.get(name, "unknown")
    if bad := [v for k, v in answers.items() if k in ("taxon_name", "location_name", "individual_id", "trait_name", "value") and v not in columns]:
        raise ValueError(f"not columns of the data: {bad}")
    primary = {"key": dataset_id, "bibtype": "Article", "author": "unknown", "year": "unknown", "title": "unknown"}
    people = {"data_collectors": [{"last_name": "unknown", "given_name": "unknown", "ORCID": "unknown", "affiliation": "unknown"}], "assistants": "unknown", "dataset_curators": "unknown"}
    return {"source": {"primary": primary}, "contributors": people, "dataset": dataset, **{s: None for s in SECTIONS[3:]}}


def _records(program: dict, section: str) -> list[dict]:
    return list(program.get(section) or [])


def add_traits(program: dict, names: list[str]) -> dict:
    """Maps columns or trait names that aren't mapped yet, with ``unknown`` to fill in."""
    have = {t["var_in"] for t in _records(program, "traits")}
    fields = ["unit_in", "trait_name", "entity_type", "value_type", "basis_of_value", "replicates", "methods"]
    return {**program, "traits": _records(program, "traits") + [{"var_in": n, **dict.fromkeys(fields, "unknown")} for n in names if n not in have]}


def add_locations(program: dict, rows: list[dict], name: str) -> dict:
    """Locations from rows of properties; a location given twice with different properties is an error."""
    out = {}
    for r in rows:
        properties = {k: v for k, v in r.items() if k != name}
        if out.setdefault(str(r[name]), properties) != properties:
            raise ValueError(f"location {r[name]} is described twice")
    return {**program, "locations": out}


def add_contexts(program: dict, values: dict[str, list[str]], overwrite: bool = False) -> dict:
    """A context for each column, with its different values to describe."""
    new = [{"context_property": "unknown", "category": "unknown", "var_in": c, "values": [{"find": v, "value": "unknown", "description": "unknown"} for v in vs]} for c, vs in values.items()]
    return {**program, "contexts": new if overwrite else _records(program, "contexts") + new}


def add_identifiers(program: dict, columns: list[str], overwrite: bool = False) -> dict:
    new = [{"var_in": c, "identifier_type": "unknown", "institution_code": None} for c in columns]
    return {**program, "identifiers": new if overwrite else _records(program, "identifiers") + new}


def add_source(program: dict, bib: dict, kind: str = "primary", drop: tuple[str, ...] = ("dateobj", "month")) -> dict:
    """A source from a bibliography entry; its key is Author_Year, and a DOI replaces a URL."""
    bib = {k: v for k, v in bib.items() if k not in drop}
    if "doi" in bib:
        bib.pop("url", None)
        bib["doi"] = re.sub(r"^(https?://)?doi\.org/", "", bib["doi"])
    author = re.split(r",| and ", bib.get("author", "unknown"))[0].strip().split(" ")[-1].title()
    first = {"key": f"{author}_{bib.get('year', 'unknown')}", "bibtype": bib.pop("bibtype", "Article")}
    order = ["year", "author", "title", "journal", "volume", "number", "pages", "doi", "url"]
    rest = {k: bib[k] for k in [*order, *[k for k in bib if k not in order]] if k in bib and k != "key"}
    return {**program, "source": {**(program.get("source") or {}), kind: {**first, **rest}}}


def read_bibtex(text: str) -> dict:
    """The first entry of a BibTeX text."""
    entries = read_bibtex_entries(text)
    if not entries:
        raise ValueError("no BibTeX entry")
    return entries[0]


def read_bibtex_entries(text: str) -> list[dict]:
    """All entries of a BibTeX text, with bibtype and key."""
    heads = list(re.finditer(r"@(\w+)\s*\{\s*([^,\s]*)\s*,", text))
    out = []
    for head, end in zip(heads, [*[h.start() for h in heads[1:]], len(text)]):
        fields = re.findall(r"(\w+)\s*=\s*(?:\{((?:[^{}]|\{[^{}]*\})*)\}|\"([^\"]*)\"|(\d+))", text[head.end() : end])
        out.append({"bibtype": head[1].title(), "key": head[2], **{k.lower(): re.sub(r"[{}]", "", next(x for x in v if x)) for k, *v in fields if any(v)}})
    return out


def to_bibtex(source: dict) -> str:
    """A source as a BibTeX entry: authors joined by ``and``, the title in braces so that it keeps its capitals."""
    rest = {k: v for k, v in source.items() if k not in ("key", "bibtype") and v is not None}
    if "author" in rest:
        rest["author"] = re.sub(r"\s+and\s+", " and ", str(rest["author"]).replace(",", " and "))
    if "title" in rest:
        rest["title"] = f"{{{rest['title']}}}"
    return f"@{source.get('bibtype', 'Misc')}{{{source['key']},\n" + "".join(f"  {k} = {{{v}}},\n" for k, v in rest.items()) + "}\n"


def from_bibtex_people(bib: dict) -> dict:
    """A bibliography entry as plain fields: lists of authors and editors joined by ``and``."""
    return {k: " and ".join(map(str, v)) if k in ("author", "editor") and isinstance(v, (list, tuple)) else v for k, v in bib.items()}


def authors(text: str) -> str:
    """Names with initials before the family name: ``A. Doe``, ``A. Doe and B. Roe``, ``A. Doe, B. Roe, and C. Poe``.

    Names are given first, are separated by ``and`` or commas.
    """
    names = [n.split() for n in re.split(r"\s+and\s+|\s*,\s*", text.strip()) if n]
    short = [" ".join([*(f"{part[0]}." for part in n[:-1]), n[-1]]) for n in names]
    if len(short) < 3:
        return " and ".join(short)
    return ", ".join(short[:-1]) + ", and " + short[-1]


#: What a thesis is called by the type of its entry.
THESES = {"phdthesis": "PhD thesis", "mastersthesis": "MA thesis", "thesis": None}


def citation(bib: dict) -> str:
    """A citation in the form of its type of entry, as markdown; what is missing or unknown is left out."""
    kind = str(bib.get("bibtype") or "Misc").lower()
    f = {k: str(v).strip() for k, v in bib.items() if v is not None and str(v).strip().lower() not in ("", "unknown")}
    quoted, emphasised = (mark + f.get("title", "") + mark for mark in ('"', "_"))
    pages = f.get("pages", "").replace("--", "-")
    pages = f"pp. {pages}" if re.search(r"[-,]", pages) else f"p. {pages}" if pages else None
    listed = lambda *parts: ", ".join(p for p in parts if p)
    publisher = f.get("institution") or f.get("school") or f.get("publisher")
    if kind == "article":
        issue = ".".join(f[k] for k in ("volume", "number") if k in f)
        where = " ".join(x for x in (f"_{f['journal']}_" if "journal" in f else "", issue, f"({f['year']})" if "year" in f else "") if x)
        parts = [quoted, "  " + listed(where, pages)]
    elif kind in ("conference", "inproceedings", "incollection", "inbook"):
        parts = [quoted, f"In: _{f['booktitle']}_" if "booktitle" in f else None, listed(publisher, f.get("year"), pages)]
    elif kind == "techreport":
        parts = [emphasised, "Tech. rep." + (f" {f['number']}." if "number" in f else ""), listed(publisher, f.get("year"), pages)]
    elif kind in THESES:
        parts = [quoted, f.get("type") or THESES[kind], listed(publisher, f.get("year"))]
    elif kind == "unpublished":
        parts = [quoted, f.get("year")]
    else:
        parts = [emphasised, listed(publisher, f.get("year"), pages)]
    text = " ".join((p if p.endswith(".") else f"{p}.") for p in [authors(f.get("author", "")), *parts] if p and p.strip())
    for name, link in (("doi", "https://doi.org/{}"), ("url", "{}")):
        if name in f and not (name == "url" and "doi" in f):
            target = link.format(quote(f[name], safe="") if name == "doi" else f[name])
            text += f"  {name}:  [{f[name]}]({target})."
    return text


def citations(entries: list[dict]) -> str | None:
    """Several citations in one text, separated by semicolons."""
    texts = [citation(e) for e in entries]
    return "; ".join([*(t.removesuffix(".") for t in texts[:-1]), texts[-1]]) if texts else None


def add_substitution(program: dict, trait: str, find: str, replace: str | None) -> dict:
    old = _records(program, "substitutions")
    if any(s["trait_name"] == trait and s["find"] == find for s in old):
        return program
    return {**program, "substitutions": [*old, {"trait_name": trait, "find": find, "replace": replace}]}


def add_substitutions_table(programs: dict[str, dict], rows: list[dict], dataset_id: str, trait_name: str, find: str, replace: str) -> tuple[dict[str, dict], list[str]]:
    """Programs with the substitutions of a table over many datasets, in its order, and notes on those that were there.

    The last four arguments name the table's columns.  A text that a dataset's trait has already is added all the same.
    """
    for column in (dataset_id, trait_name, find, replace):
        if lost := [r for r in rows if column not in r]:
            raise ValueError(f"'{column}' is not a column in the substitutions table: {lost[:1]}")
    out, notes = dict(programs), []
    for r in rows:
        old = _records(out[r[dataset_id]], "substitutions")
        if any(s["trait_name"] == r[trait_name] and s["find"] == r[find] for s in old):
            notes.append(f"{r[dataset_id]}: {r[trait_name]}: '{r[find]}' already exists; review both")
        out[r[dataset_id]] = {**out[r[dataset_id]], "substitutions": [*old, {"trait_name": r[trait_name], "find": r[find], "replace": r[replace]}]}
    return out, notes


def set_substitutions(program: dict, rows: list[dict]) -> dict:
    return {**program, "substitutions": rows or None}


def add_taxonomic_change(program: dict, find: str, replace: str, reason: str, resolution: str, overwrite: bool = True) -> dict:
    """Adds or replaces a name change; changes of a name to itself go; changes are sorted by the name they find."""
    old = {u["find"]: u for u in _records(program, "taxonomic_updates")}
    if overwrite or find not in old:
        old[find] = {"find": find, "replace": replace, "reason": reason, "taxonomic_resolution": resolution}
    return {**program, "taxonomic_updates": sorted((u for u in old.values() if u["find"] != u["replace"]), key=lambda u: u["find"]) or None}


def add_taxonomic_changes(program: dict, rows: list[dict]) -> dict:
    for r in rows:
        program = add_taxonomic_change(program, r["find"], r["replace"], r.get("reason"), r.get("taxonomic_resolution"))
    return program


def update_taxonomic_change(program: dict, find: str, replace: str, reason: str, resolution: str) -> dict:
    if find not in {u["find"] for u in _records(program, "taxonomic_updates")}:
        raise KeyError(find)
    return add_taxonomic_change(program, find, replace, reason, resolution)


def remove_taxonomic_change(program: dict, find: str) -> dict:
    return {**program, "taxonomic_updates": [u for u in _records(program, "taxonomic_updates") if u["find"] != find] or None}


def find_taxonomic_changes(programs: dict[str, dict], find: str, replace: str | None = None) -> list[str]:
    """Datasets whose programs change that name (to that one)."""
    hit = lambda u: u["find"] == find and (replace is None or u["replace"] == replace)
    return sorted(i for i, p in programs.items() if any(hit(u) for u in _records(p, "taxonomic_updates")))


def exclude_observations(program: dict, variable: str, find: str, reason: str) -> dict:
    old = _records(program, "exclude_observations")
    new = {"variable": variable, "find": find, "reason": reason}
    return program if new in old else {**program, "exclude_observations": [*old, new]}


def discover(folder: str | Path) -> list[str]:
    """Datasets (folders) that have both their files."""
    return sorted(p.name for p in Path(folder).iterdir() if (p / "data.csv").exists() and (p / "metadata.yml").exists())


def get_schema(path: str | Path, subsection: str | None = None) -> dict:
    """A schema document, or one section of it."""
    schema = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    return schema if subsection is None else schema[subsection]


def get_version(path: str | Path) -> str:
    """The version that a compilation's metadata document gives."""
    return get_schema(path, "metadata")["version"]


def git_commit(path: str | Path = ".") -> str | None:
    """The hash of the last commit of the repository at a path; None if there is none."""
    for folder in [Path(path).resolve(), *Path(path).resolve().parents]:
        head = folder / ".git" / "HEAD"
        if head.is_file():
            text = head.read_text().strip()
            if not text.startswith("ref: "):
                return text
            name, packed = text[5:], folder / ".git" / "packed-refs"
            if (folder / ".git" / name).is_file():
                return (folder / ".git" / name).read_text().strip()
            found = [line.split(" ")[0] for line in packed.read_text().split("\n") if line.endswith(f" {name}")] if packed.is_file() else []
            return found[0] if found else None
    return None


def read_conversion_rows(path: str | Path) -> list[dict]:
    """Rows (unit_from, unit_to, function) of a unit-conversion CSV."""
    with open(path, encoding="utf-8", newline="") as f:
        return list(csv.DictReader(f))


def set_up(folder: str | Path) -> None:
    """The configuration folder of a new compilation, with an empty taxon list unless there is one."""
    path = Path(folder, "config", "taxon_list.csv")
    path.parent.mkdir(parents=True, exist_ok=True)
    if not path.exists():
        path.write_text(",".join(TAXON_LIST) + "\n", encoding="utf-8")
