"""Structured Streaming forms of the detector and its reports (ST1-ST7).

Event time is the packet timestamp (``event_time`` = ``timestamp_micros(ts_us)``)
with a watermark; every query runs with checkpointed state and can be run
with ``Trigger.AvailableNow`` over a directory of files (what the registered
queries and the stream = batch tests do) or continuously.
"""
