"""Structured Streaming jobs: continuous ingest (+ enrich) and live composition."""


def drain_and_stop(query, timeout_s: float | None = None) -> None:
    """Graceful stop of a continuously triggered query: process everything that
    has arrived, then stop (the checkpoint records the last committed batch).

    With ``timeout_s`` an unfinished drain stops the query all the same and
    raises ``TimeoutError``; the next start goes on from the checkpoint.
    """
    import threading
    drain = threading.Thread(target=query.processAllAvailable, daemon=True)
    drain.start()
    drain.join(timeout_s)
    late = drain.is_alive()
    query.stop()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))
    if late:
        raise TimeoutError(f"not drained within {timeout_s} s")
