"""The best rows of each query while scores stream by, for tasks that score a part of the rows."""
import numpy as np
import pyarrow as pa


class Best:
    """At most k (score, id) of each of `queries`: highest scores, then smallest ids."""
    def __init__(self, queries: int, k: int):
        self.k, self.held, self.kind = k, {}, None
        self.low = np.full(queries, -np.inf)  # of queries that hold k rows: the least score

    def add(self, first: int, scores: np.ndarray, ids: pa.Array) -> None:
        """Scores (queries from `first` on x rows) of rows ids; NaN and -inf are no hits."""
        self.kind = ids.type
        q, r = np.nonzero(scores >= np.maximum(self.low[first:first + len(scores)], np.finfo(float).min)[:, None])
        if not len(q):
            return
        ids = ids.to_numpy(zero_copy_only=False)
        s, i = scores[q, r], ids[r]
        ends = np.flatnonzero(np.diff(q, append=-1)) + 1
        for a, b in zip([0, *ends[:-1]], ends):
            n, t, j = first + int(q[a]), s[a:b], i[a:b]
            if n in self.held:
                t, j = np.concatenate([self.held[n][0], t]), np.concatenate([self.held[n][1], j])
            if len(t) > self.k:
                if len(t) > 4 * self.k:  # ties of the last one stay
                    keep = t >= np.partition(t, len(t) - self.k)[len(t) - self.k]
                    t, j = t[keep], j[keep]
                top = np.lexsort((j, -t))[:self.k]
                t, j = t[top], j[top]
            self.held[n] = t, j
            if len(t) == self.k:
                self.low[n] = t.min()

    def batches(self, names: pa.Array, at_once: int = 100_000):
        """query_id, id, score."""
        ns, size = [], 0
        for n in self.held:
            ns.append(n)
            size += len(self.held[n][0])
            if size >= at_once:
                yield self._batch(ns, names)
                ns, size = [], 0
        if ns:
            yield self._batch(ns, names)

    def _batch(self, ns, names):
        q = np.repeat(ns, [len(self.held[n][0]) for n in ns])
        ids = np.concatenate([self.held[n][1] for n in ns])
        return pa.RecordBatch.from_arrays([names.take(pa.array(q)), pa.array(ids, self.kind), pa.array(np.concatenate([self.held[n][0] for n in ns]))], ["query_id", "id", "score"])
