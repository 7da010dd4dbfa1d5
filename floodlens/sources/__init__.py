"""Scans and sinks (S1-S10) and the packet view over the driver's ``events`` table."""
