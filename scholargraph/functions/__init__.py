"""Column-level helpers shared by the operators (all JVM-side built-ins)."""
from scholargraph.functions.text import fold, tokens, strip_ws, is_blank, php_empty  # noqa: F401
from scholargraph.functions.ids import stable_id, dense_index  # noqa: F401
