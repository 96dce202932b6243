"""Programs to fill in, made from a schema: a walk over the tree of its metadata section."""

from __future__ import annotations

from .program import DATASET_FIELDS, SECTIONS

#: Fields of a new program's dataset section, in order; those that name columns stand only if they are given.
ORDER = "data_is_long_format custom_R_code collection_date taxon_name trait_name value location_name individual_id repeat_measurements_id description basis_of_record life_stage sampling_strategy original_file notes".split()
COLUMN_FIELDS = ["taxon_name", "trait_name", "value", "location_name", "individual_id"]
#: Other fields that a schema may list, which programs get only when someone adds them.
LATER = [*DATASET_FIELDS, "treatment_context_id", "observation_id"]
UNKNOWN = "unknown"


def children(node) -> dict:
    """The parts of a node of a schema; none of a leaf."""
    return (node.get("elements") or node.get("values") or {}) if isinstance(node, dict) else {}


def placeholders(node, within_array: bool = False):
    """A structure like a schema's node, with ``unknown`` for each leaf; what an array's parts describe is a list of one record."""
    parts = children(node)
    if not parts:
        return UNKNOWN
    out = {name: placeholders(part, isinstance(node, dict) and node.get("type") == "array") for name, part in parts.items()}
    return [out] if within_array else out


def template_from_schema(schema: dict, dataset_id: str, columns: list[str], answers: dict | None = None) -> dict:
    """A new dataset's program: all sections of the schema, with placeholders where a text is needed.

    ``answers`` fill fields of the dataset section; those that name columns must name columns of the data.  Of the sources
    only the primary one is asked for.  Sections of lists that grow as a program is written are empty.
    """
    answers = answers or {}
    sections = children(schema["metadata"])
    if bad := [f"{k}: {answers[k]}" for k in COLUMN_FIELDS if answers.get(k) is not None and answers[k] not in columns]:
        raise ValueError(f"not columns of the data: {bad}")
    out = {}
    for name in [*[s for s in SECTIONS if s in sections], *[s for s in sections if s not in SECTIONS]]:
        if name == "source":
            primary = placeholders(sections[name])["primary"]
            out[name] = {"primary": {**(primary if isinstance(primary, dict) else {}), "key": dataset_id}}
        elif name == "dataset":
            own = children(sections[name])
            wanted = [f for f in ORDER if f in own or f in answers] + [f for f in own if f not in ORDER and (f not in LATER or f in answers)]
            out[name] = {f: answers.get(f, None if f == "custom_R_code" else UNKNOWN) for f in wanted if f in answers or f not in [*COLUMN_FIELDS[1:], "repeat_measurements_id"]}
        elif name == "contributors":
            out[name] = placeholders(sections[name])
        elif name in SECTIONS:
            out[name] = None
        else:
            out[name] = placeholders(sections[name])
    return out
