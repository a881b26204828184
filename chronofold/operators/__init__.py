"""Analytics over record frames.

A record frame has ``user_id, date, elapsed_s`` and, where an operator says so,
``task_name, subtask, tag, begin_ts, log``. ``keys`` are the columns that keep people apart;
with ``keys=()`` an operator answers for all records together.
"""
