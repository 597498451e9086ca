"""A log-bilinear language model in numpy, trained by noise-contrastive estimation.

A context of ``WIDTH`` units predicts a vector: the sum of its units' vectors, each position having vectors of its own
(its matrix times the unit's vector, learned as one).  The score of a unit is that vector times the unit's output vector,
plus the unit's bias.  Training tells each next unit from units drawn from the unigram distribution (one draw for all
contexts of a batch), with the scores taken as log-probabilities that need no normalising; scoring normalises over all
units with one matrix product a batch.

More than ``FLAT`` units are predicted in two choices: one of the first ``HEAD`` units, of the units after the last group,
or a group of ``GROUP`` units or somewhat more that follow one another; then a unit of the group.  Groups are of one size, which
leaves ``TAIL`` units and less than one for each group single at the end.  A group has a vector and a bias as a unit has,
both choices are estimated and normalised in the same way, and their probabilities are multiplied.  So each unit has
parameters of its own, and a token costs about the square root of the number of units.
"""

from __future__ import annotations

import numpy as np

#: Units of context, length of vectors, contexts of a training batch and of a scoring batch, noise units of a batch, and
#: how many noise units the estimation counts for each unit of data; noise units of a batch within a group.
WIDTH, SIZE, BATCH, SCORED_AT_ONCE, DRAWN, NOISE, DRAWN_WITHIN = 4, 16, 1024, 512, 64, 16, 32
#: Units up to which there are no groups; of more, those at the start and at the end that are single, and units of a group at least.
FLAT, HEAD, TAIL, GROUP = 512, 128, 33, 256
#: Scores up to here, either way, are taken to ``exp`` as they are.
FAR = 80
#: Rows up to which a gradient is that of all rows; of more, it is that of the rows which the batch meets.
DENSE = 2048
F32 = np.float32
#: A vector as one value, which is moved faster.
WHOLE = f"V{4 * SIZE}"


class LogBilinear:
    """inputs, outputs: how many units stand in contexts (the last one is the start of a text) and are predicted."""

    def __init__(self, inputs: int, outputs: int, parameters: np.ndarray | None = None, seed: int = 0):
        self.groups = (outputs - HEAD) // GROUP if outputs > FLAT else 0
        rows = outputs + self.groups
        self.shapes = [(WIDTH * inputs, SIZE), (rows, SIZE), (rows,)]
        if parameters is None:
            rng = np.random.default_rng(seed)
            parameters = np.concatenate([rng.normal(0, 0.1, WIDTH * inputs * SIZE), rng.normal(0, 0.1, rows * SIZE), np.zeros(rows)])
        ends = np.cumsum([np.prod(s) for s in self.shapes])
        self.inputs = inputs
        self.parameters = parameters.astype(F32)  # one array; the parts below are views of it
        self.vectors, self.targets, self.bias = (x.reshape(s) for x, s in zip(np.split(self.parameters, ends[:-1]), self.shapes, strict=True))
        self.squares = np.full(len(self.parameters), 1e-5, F32)  # of the gradients so far
        self.parts = [slice(a, b) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        self.start = HEAD if self.groups else outputs  # of the groups
        self.size = (outputs - HEAD - TAIL) // self.groups if self.groups else 0
        self.stop = self.start + self.groups * self.size
        # the rows of the first choice, and which of them leads to each unit
        self.first = np.concatenate([np.arange(self.start), np.arange(self.stop, outputs), np.arange(outputs, rows)])
        single = self.start + outputs - self.stop
        self.last_met = np.empty(max(WIDTH * inputs, rows), np.intp)
        self.choice = np.concatenate([np.arange(self.start), single + np.repeat(np.arange(self.groups), self.size), np.arange(self.start, single)])

    def _predicted(self, contexts: np.ndarray) -> np.ndarray:
        """contexts: a row of each position, with the rows of ``vectors`` that stand there."""
        h = self.vectors.take(contexts[0], 0)
        for row in contexts[1:]:
            h += self.vectors.take(row, 0)
        return h

    def _step(self, part: int, gradient: np.ndarray, rate: float) -> None:
        at, g = self.parts[part], gradient.ravel().astype(F32)
        self.squares[at] += g * g
        self.parameters[at] -= rate * g / np.sqrt(self.squares[at])

    def _step_rows(self, part: int, rows: np.ndarray | slice, gradient: np.ndarray, rate: float) -> None:
        """A step of some rows, each given once."""
        values, squares = (x[self.parts[part]].reshape(self.shapes[part]) for x in (self.parameters, self.squares))
        if isinstance(rows, slice) or gradient.ndim == 1:
            squares[rows] += gradient * gradient
            values[rows] -= F32(rate) * gradient / np.sqrt(squares[rows])
            return
        new = squares.take(rows, 0)
        new += gradient * gradient
        squares.view(WHOLE)[rows] = new.view(WHOLE)
        np.sqrt(new, out=new)
        np.divide(gradient, new, out=new)
        new *= F32(-rate)
        new += values.take(rows, 0)
        values.view(WHOLE)[rows] = new.view(WHOLE)

    @staticmethod
    def _gathered(n: int, number: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The sums of the rows with each of n numbers; ``number`` may hold several numbers of each row, one after the other."""
        columns = rows.view(np.complex64)  # two columns as one complex value, which are added together
        out = np.zeros((SIZE // 2, n), np.complex64)
        values = np.empty((len(number) // len(rows), len(rows)), np.complex64)
        for k, sums in enumerate(out):
            values[:] = columns[:, k]
            np.add.at(sums, number, values.ravel())
        return np.ascontiguousarray(out.T).view(F32)

    def _learn_vectors(self, context: np.ndarray, d_h: np.ndarray, rate: float) -> None:
        rows = context.ravel()
        n = len(self.vectors)
        if n <= DENSE:
            return self._step(0, self._gathered(n, rows, d_h), rate)
        turn = np.arange(len(rows))
        self.last_met[rows] = turn
        last = self.last_met.take(rows)
        kept = last == turn
        met, number = rows[kept], (np.cumsum(kept) - 1).take(last)
        return self._step_rows(0, met, self._gathered(len(met), number, d_h), rate)

    def _choose(self, h: np.ndarray, unit: np.ndarray, rows: np.ndarray | slice, noise: tuple, rng: np.random.Generator, rate: float, size: int, n_drawn: int = DRAWN) -> np.ndarray:
        """A step for the choice of ``unit`` among ``rows``; the derivatives by the predicted vectors.
        noise: logarithms of the expected numbers, and chances, added up; size: what the sums are divided by."""
        expected, chances = noise
        n = len(chances)
        times = np.bincount(np.minimum(np.searchsorted(chances, rng.random(n_drawn) * chances[-1], side="right"), n - 1), minlength=n)
        drawn = np.flatnonzero(times)
        targets, bias = (self.targets[rows], self.bias[rows]) if isinstance(rows, slice) else (self.targets.take(rows, 0), self.bias.take(rows))
        bias = bias - expected
        own_targets, other_targets = targets.take(unit, 0), targets.take(drawn, 0)
        own = np.einsum("bd,bd->b", h, own_targets) + bias.take(unit)
        other = h @ -other_targets.T
        # derivatives of -log sigmoid(own) and of -log sigmoid(-other), over the batch
        d_own = -F32(1 / size) / (1 + np.exp(own))
        d_other, odds = np.exp(other, out=other), np.exp(np.clip(bias[drawn], -60, 60))
        d_other += odds
        np.divide(F32(NOISE / n_drawn / size) * times[drawn].astype(F32) * odds, d_other, out=d_other)
        d_h = d_other @ other_targets
        d_h += d_own[:, None] * own_targets
        d_targets, d_bias = self._gathered(n, unit, d_own[:, None] * h), np.bincount(unit, d_own, n)
        d_targets[drawn] += d_other.T @ h
        d_bias[drawn] += np.ones(len(h), F32) @ d_other
        for part, gradient in ((1, d_targets), (2, d_bias.astype(F32))):
            if self.groups:
                self._step_rows(part, rows, gradient, rate)
            else:
                self._step(part, gradient, rate)
        return d_h

    def _by_group(self, units: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """The groups that units are in, and the places of these units."""
        places = np.flatnonzero((units >= self.start) & (units < self.stop))
        group = ((units[places] - self.start) // self.size).astype(np.int16)  # which is sorted faster
        order = np.argsort(group, kind="stable")
        cuts = np.searchsorted(group[order], np.arange(self.groups + 1))
        return [(g, places[order[a:b]]) for g, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]

    def learn(self, contexts: np.ndarray, units: np.ndarray, noise: np.ndarray, rng: np.random.Generator, rate: float) -> None:
        """One pass; noise: probability of each unit as noise. The choices within groups come first, group by group; what
        they ask of the vectors is added to the step of the batch that a place is in."""
        prepared = lambda p: (np.log(NOISE * np.maximum(p, 1e-12)).astype(F32), np.cumsum(p))
        with np.errstate(over="ignore"):
            contexts, groups = np.ascontiguousarray(contexts, np.intp), self._by_group(units)  # as numpy takes by them, row by row
            within = np.zeros((len(units), SIZE), F32) if groups else None
            for k in rng.permutation(len(groups)) if groups else ():
                g, places = groups[k]
                rows = slice(self.start + g * self.size, self.start + (g + 1) * self.size)
                own = prepared(noise[rows] / noise[rows].sum())
                for at in range(0, len(places), BATCH):
                    some = places[at : at + BATCH]
                    d_h = self._choose(self._predicted(contexts.take(some, 1)), units[some] - rows.start, rows, own, rng, rate, BATCH, DRAWN_WITHIN)
                    within.view(WHOLE)[some] = d_h.view(WHOLE)
            chosen, own = self.choice[units], prepared(np.bincount(self.choice, noise, len(self.first)))
            for at in range(0, len(units), BATCH):
                context, unit = contexts[:, at : at + BATCH], chosen[at : at + BATCH]
                d_h = self._choose(self._predicted(context), unit, self.first, own, rng, rate, len(unit))
                if groups:
                    d_h += within[at : at + BATCH]
                self._learn_vectors(context, d_h, rate)

    def _log_share(self, h: np.ndarray, unit: np.ndarray, rows: np.ndarray, possible: np.ndarray) -> np.ndarray:
        """The logarithm of each unit's probability among the possible ones of ``rows``, with one matrix product a batch."""
        allowed = rows[possible]
        place = (np.cumsum(possible) - 1)[unit]
        targets, bias, ones = self.targets[allowed], self.bias[allowed], np.ones(len(allowed), F32)
        own = np.einsum("bd,bd->b", h, targets.take(place, 0)).astype(np.float64) + bias[place]
        # elsewhere exp might leave the range, or the sum be 0
        near = np.sqrt(np.einsum("bd,bd->b", h, h) * np.square(targets).sum(1).max()) + abs(bias.max()) < FAR
        targets = np.concatenate([targets.T, bias[None]])
        h = np.concatenate([h, np.ones((len(h), 1), F32)], axis=1)
        out = np.empty(len(unit))
        for some in (np.flatnonzero(near), np.flatnonzero(~near)):
            for at in range(0, len(some), SCORED_AT_ONCE):
                batch = some[at : at + SCORED_AT_ONCE]
                scores, most = h.take(batch, 0) @ targets, F32(0)
                if not near[batch[0]]:
                    most = scores.max(1, keepdims=True)
                    scores -= most
                out[batch] = np.log(np.exp(scores, out=scores) @ ones) + np.ravel(most)
        return own - out

    def log10(self, contexts: np.ndarray, units: np.ndarray, possible: np.ndarray) -> np.ndarray:
        """log10 of each unit's probability after its context; units that are not possible have none."""
        h = self._predicted(contexts)
        out = self._log_share(h, self.choice[units], self.first, np.bincount(self.choice, possible, len(self.first)) > 0)
        for g, places in self._by_group(units):
            rows = np.arange(self.start + g * self.size, self.start + (g + 1) * self.size)
            out[places] += self._log_share(h.take(places, 0), units[places] - rows[0], rows, possible[rows])
        return out / np.log(10)


def contexts_of(units: np.ndarray, offsets: np.ndarray, inputs: int) -> np.ndarray:
    """The WIDTH units before each unit of texts as rows of ``vectors``, a row of each position, the nearest first; the
    last of the inputs stands before a text."""
    before = np.arange(len(units)) - np.repeat(offsets[:-1], np.diff(offsets))
    out = np.empty((WIDTH, len(units)), np.int32)
    for k, row in enumerate(out):
        row[: k + 1] = inputs - 1
        row[k + 1 :] = units[: max(0, len(units) - k - 1)]
        row[before <= k] = inputs - 1
        row += k * inputs
    return out
