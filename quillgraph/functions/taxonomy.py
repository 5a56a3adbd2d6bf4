"""Entity types and their colours."""

from __future__ import annotations

# The entity types, and the colour of each.
TYPE_COLOR = {
    "person": "#e66767",
    "organization": "#3987e5",
    "location": "#008300",
    "concept": "#9085e9",
    "event": "#d95926",
    "artifact": "#199e70",
    "quantity": "#c98500",
    "time": "#d55181",
    "other": "#8a8a85",
}
ENTITY_TYPES = tuple(TYPE_COLOR)

MENTION = "struct<name:string,type:string>"
PROPOSITIONS = f"doc_id bigint, chunk_index int, pos int, local_id string, text string, subject {MENTION}, predicate string, object {MENTION}, confidence double"
