"""Folds of sample queues and of samples that outlive a version of the parameters, for ordered_fold()."""

from __future__ import annotations


def two_queues(capacity: int):
    """A queue of samples with a side queue of validation results, one operation a row: (op, id).

    put: an item of the row's id; to a waiting consumer, else to the queue, which drops its oldest when full. get: the oldest item, else the
    consumer waits, or is told the end once the queue is shut. put_validate and get_validate: the side queue, whose consumers never wait. shutdown: waiting
    consumers are told the end; what the queue holds can still be got. Out: consumer (id of its get), item, mark ('item', 'end', 'validate',
    'none'), size (of the queue it got from, afterwards), dropped (so far)."""

    def fold(state, row):
        s = state or {"queue": [], "side": [], "waiting": [], "open": True, "dropped": 0}
        op, own, out = row["op"], row["id"], []
        queue, side, waiting = s["queue"], s["side"], s["waiting"]
        if op == "put":
            if waiting:
                out.append((waiting.pop(0), own, "item", 0, s["dropped"]))
            else:
                if len(queue) >= capacity:
                    queue.pop(0)
                    s["dropped"] += 1
                queue.append(own)
        elif op == "get":
            if queue:
                item = queue.pop(0)
                out.append((own, item, "item", len(queue), s["dropped"]))
            elif s["open"]:
                waiting.append(own)
            else:
                out.append((own, None, "end", 0, s["dropped"]))
        elif op == "put_validate":
            side.append(own)
        elif op == "get_validate":
            item = side.pop(0) if side else None
            out.append((own, item, "none" if item is None else "validate", len(side), s["dropped"]))
        elif op == "shutdown":
            s["open"] = False
            out += [(w, None, "end", 0, s["dropped"]) for w in waiting]
            s["waiting"] = []
        else:
            raise ValueError(f"unknown operation: {op}")
        return s, out

    return fold, "consumer long, item long, mark string, size int, dropped long"


def resumed_rollouts(limit: int):
    """Segments of generation, one a row: (id, version, tokens, cancelled). A segment that was cancelled by an update of the parameters goes on
    under the next version, after the tokens it had; a sample is done with a segment that wasn't cancelled, or when it has `limit` tokens, which
    are all it keeps. Out: attempt, tokens, starts (of each segment, in tokens), versions (of each segment), start_version, end_version, is_partial."""

    def fold(state, row):
        s = state or {"attempt": 0, "tokens": [], "starts": [], "versions": []}
        s["starts"].append(len(s["tokens"]))
        s["versions"].append(row["version"])
        s["tokens"] += [int(x) for x in row["tokens"]]
        if row["cancelled"] and len(s["tokens"]) < limit:
            return s, []
        done = (s["attempt"], s["tokens"][:limit], s["starts"], s["versions"], s["versions"][0], s["versions"][-1], len(s["versions"]) > 1)
        return {"attempt": s["attempt"] + 1, "tokens": [], "starts": [], "versions": []}, [done]

    return fold, "attempt int, tokens array<long>, starts array<int>, versions array<long>, start_version long, end_version long, is_partial boolean"
