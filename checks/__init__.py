"""SQL checks of the registered queries."""
