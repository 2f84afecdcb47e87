"""The graph's vocabulary: edge types, identifiers and schemas."""

from __future__ import annotations

# The closed vocabulary of edge types.
ALIAS_FROM, ALIAS_TO = "alias:from", "alias:to"
CONTAINED_BY, CONTAINS = "contained:up", "contained:down"
BUILT_FROM, BUILDS_TO = "build:down", "build:up"
TAG_FROM, TAG_TO = "tag:from", "tag:to"

#: Edge types whose reverse is generated; the others get none.
REVERSED = {ALIAS_FROM: ALIAS_TO, CONTAINED_BY: CONTAINS, BUILT_FROM: BUILDS_TO, TAG_FROM: TAG_TO}
#: Along these a removal spreads from an item to what depends on it.
UPWARD = (CONTAINED_BY, BUILDS_TO, ALIAS_FROM, ALIAS_TO)

BLOB_PREFIX = "gitoid:blob:sha256:"
TAGS = "tags"
METADATA_BODY, TAG_BODY = "application/vnd.artifact-graph", "application/vnd.artifact-graph.tag"

EDGES = "src string, edge_type string, dst string"
EXTRA = "id string, key string, mime string, value string"
ITEMS = "id string, body_mime string, file_names array<string>, mime_types array<string>, file_size long"
