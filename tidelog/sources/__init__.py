"""Sources, wire format and configuration of the engine."""
