"""Job chains and the registered queries."""
