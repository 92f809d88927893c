"""Long texts of a kind compared with each other: the function of a cell of two parts of them.

Most pairs are told apart by their symbols: what two texts have in common is at most the smaller count of
each symbol. Text i meets text i + r for a run of i and some r at once, so both counts lie in order in memory and
a pair costs a few nanoseconds. For those that are left the longest common subsequence is found as in
``lcs_length``, for many pairs a step. A row of it is kept only as far as K changes can lead away from the
diagonal, so it is mostly one number of 64 bits, and pairs whose lost symbols are already too many are left
out on the way. That is exact for all pairs that match.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

# Symbols that are counted one by one; the others are counted together.
ALONE = 40


def matches_of_cell(above: int, with_texts: bool):
    """The function that gives the matches of a cell; nested in one piece, so that it travels with the task.

    ``above``: pairs that may differ by no more than that are left out.
    """
    alone, turns, widest, lanes, room = ALONE, 64, 1024, 16384, 1 << 23

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        cell = pa.Table.from_batches(list(batches))
        if not cell.num_rows:
            return
        kind, threshold, lo, hi = (cell.column(c)[0].as_py() for c in ("kind", "threshold", "_lo_part", "_hi_part"))
        cell = cell.take(pc.sort_indices(cell, [("n", "ascending")])).combine_chunks()
        text, uses = (cell.column(c).combine_chunks() for c in ("text", "uses"))
        asks, part = (cell.column(c).to_numpy() for c in ("asks", "_part"))
        texts = text.to_pylist()
        n = np.fromiter(map(len, texts), np.int64, len(texts))
        rank = np.empty(len(n), np.int64)
        rank[pc.sort_indices(text).to_numpy()] = np.arange(len(n))

        # Symbols are numbered from 1, those of all texts in one array; 0 stands behind the end of a text.
        flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        seen = np.zeros(int(flat.max()) + 1, np.int64)
        seen[flat] = 1
        symbols = int(seen.sum()) + 1
        codes = np.cumsum(seen)[flat]
        starts = np.cumsum(n) - n
        often = np.argsort(-np.bincount(codes, minlength=symbols)[1:], kind="stable")
        place = np.zeros(symbols, np.int64)
        place[often + 1] = np.minimum(np.arange(symbols - 1), alone)
        kinds = min(symbols - 1, alone + 1)
        small = np.uint8 if n.max() < 2**8 else np.uint16 if n.max() < 2**16 else np.uint32
        counts, at = np.empty((kinds, len(n)), small), 0
        while at < len(n):
            to = max(at + 1, int(np.searchsorted(starts, starts[at] + (1 << 20))))
            some = place[codes[starts[at] : starts[to - 1] + n[to - 1]]] + kinds * np.repeat(np.arange(to - at), n[at:to])
            counts[:, at:to] = np.bincount(some, minlength=kinds * (to - at)).reshape(-1, kinds).T
            at = to

        def all_of(which):
            """(number of the text, place in it, symbol) for all symbols of some texts."""
            number = np.repeat(np.arange(len(which)), n[which])
            at = np.arange(len(number)) - np.repeat(np.cumsum(n[which]) - n[which], n[which])
            return number, at, codes[starts[which][number] + at]

        # By the sum of two lengths: the most that they may differ by.
        c = (100.5 - threshold) / 100.0 + 1e-9
        total = np.arange(2 * int(n.max()) + 1)
        most = np.floor(total * c).astype(np.int64)
        most -= (most + total) % 2
        # The fewest symbols that they have in common then, and a number of either text that is no more than that in sum.
        fewest = np.where(most > above, (total - most) // 2, total + 1)
        least = np.floor(n * (1 - c) / 2 - 1e-6).clip(0).astype(small)

        # As many symbols of a text as fit are one number.
        bits = 8 if symbols <= 2**8 else 16 if symbols <= 2**16 else 32
        step = 64 // bits
        xs, ys = np.flatnonzero(part == lo), np.flatnonzero(part == hi)
        # Texts lie side by side, or, where they are too unlike in length, one after another with an empty number at the end.
        numbers = -(-n[ys] // step) + 1
        beside = int(numbers.max()) * len(ys) <= room
        begins, apart = (np.arange(len(ys)), len(ys)) if beside else (np.cumsum(numbers) - numbers, 1)
        packed = np.zeros((int(numbers.max()) * len(ys) if beside else int(numbers.sum()), step), f"<u{bits // 8}")
        number, at, symbol = all_of(ys)
        packed[begins[number] + at // step * apart, at % step] = symbol
        packed = packed.view("<i8").ravel()

        def ones_at(q, y):
            if beside:
                return packed[q * apart : (q + 1) * apart].take(y)
            return packed.take(begins.take(y) + np.minimum(numbers.take(y) - 1, q))

        def by_pair(x, y):
            """What ``lengths`` gives, for a few long texts, as in ``lcs_length``."""
            out = np.empty(len(x), np.int64)
            for i, (one, other) in enumerate(zip(x, y)):
                places = {}
                for at, symbol in enumerate(texts[one]):
                    places[symbol] = places.get(symbol, 0) | 1 << at
                row = full = (1 << len(texts[one])) - 1
                for symbol in texts[other]:
                    hit = row & places.get(symbol, 0)
                    row = (row + hit | row - hit) & full
                out[i] = len(texts[one]) - row.bit_count()
            return np.arange(len(x)), out

        def lengths(x, y, ny, lose_x, lose_y, a, b, table_at):
            """For pairs of a text ``x`` of the block and a ``y`` of length ``ny``, in order of that, that may lose some symbols
            (no more than a and b): which of them may match, and the length of the longest common subsequence."""
            width = -(-(a + b + step) // 64)
            band = [np.uint64(max(0, min(2**64, 2 ** max(0, a + b - 64 * w)) - 1)) for w in range(width)]
            rows = [np.full(len(x), 2**64 - 1, np.uint64) for _ in range(width)]
            gone = np.zeros(len(x), np.int32)
            at, alive, end = x * symbols, np.arange(len(x)), int(ny.max())
            check, last = max(16, int(ny.min()) * 3 // 8), int(ny.min())
            for t in range(0, end, step):
                if t:
                    # The band moves on; increments that leave it are kept as a number.
                    left = np.uint64(2**step - 1)
                    gone += np.bitwise_count(~rows[0] & left)
                    for w in range(width):
                        above_it = rows[w + 1] if w + 1 < width else np.uint64(2**64 - 1)
                        rows[w] = (rows[w] >> np.uint64(step)) | (above_it << np.uint64(64 - step))
                    if check <= t <= last:
                        check = t + 16
                        so_far = gone.copy()
                        for w in range(width):
                            so_far += np.bitwise_count(~rows[w] & band[w])
                        keep = np.flatnonzero((t - so_far <= lose_y) & (t - b - gone <= lose_x))
                        if len(keep) < 0.8 * len(at):
                            at, alive, y, gone, lose_x, lose_y = (v[keep] for v in (at, alive, y, gone, lose_x, lose_y))
                            rows = [v[keep] for v in rows]
                            if not len(at):
                                break
                tables = table_at(t - b, width)
                next_ones = ones_at(t // step, y)
                index, mask, added = np.empty_like(at), np.empty(len(at), np.uint64), np.empty(len(at), np.uint64)
                for s in range(min(step, end - t)):
                    np.right_shift(next_ones, bits * s, out=index)
                    np.bitwise_and(index, 2**bits - 1, out=index)
                    np.add(index, at, out=index)
                    carry = None
                    for w in range(width):
                        row = rows[w]
                        tables[w].take(index, out=mask, mode="wrap")
                        np.bitwise_and(mask, row, out=mask)
                        np.add(row, mask, out=added)
                        if w + 1 < width or carry is not None:
                            over = added < mask
                            if carry is not None:
                                added += carry
                                over |= added < carry
                            carry = over.astype(np.uint64)
                        np.bitwise_xor(row, mask, out=row)
                        np.bitwise_or(row, added, out=row)
            for row in rows:
                gone = gone + np.bitwise_count(~row)
            return alive, gone

        def matches(x, y, first, places, front):
            ny = n[ys].take(y)
            order = np.argsort(ny.astype(np.uint16) if n[-1] < 2**16 else ny, kind="stable")
            x, y, ny = x.take(order), y.take(order), ny.take(order)
            nx = n[xs].take(first + x)
            k = most.take(nx + ny)
            # Symbols that x and y may lose at most; the band reaches so far to either side.
            lose_x, lose_y = ((k + nx - ny) >> 1).astype(np.int32), ((k - nx + ny) >> 1).astype(np.int32)
            a, b = int(lose_x.max()), int(lose_y.max())
            made = {}

            def table_at(start, width):
                """Where a symbol stands in each text of the block, from ``start`` on; kept for the next lanes while there is room."""
                if start in made:
                    return made[start]
                word, bit = divmod(64 * front + start, 64)
                tables = [places[w] for w in range(word, word + width)]
                if bit:
                    rest = [places[w + 1] << np.uint64(64 - bit) for w in range(word, word + width)]
                    tables = [(table >> np.uint64(bit)) | more for table, more in zip(tables, rest)]
                tables = [table.ravel() for table in tables]
                if (len(made) + 1) * width * tables[0].size <= room:
                    made[start] = tables
                return tables

            for at in range(0, len(order), lanes):
                some = slice(at, at + lanes)
                if len(x[some]) < (a + b) // 4:
                    alive, common = by_pair(xs[first + x[some]], ys[y[some]])
                else:
                    alive, common = lengths(x[some], y[some], ny[some], lose_x[some], lose_y[some], a, b, table_at)
                i, j = xs.take(first + x[some].take(alive)), ys.take(y[some].take(alive))
                score = np.rint(100.0 * ((2.0 * common) / (n[i] + n[j]))).astype(np.int32)
                good = score >= threshold
                if not good.any():
                    continue
                i, j, score = i[good], j[good], score[good]
                up = rank[i] < rank[j]
                i, j = pa.array(np.where(up, i, j)), pa.array(np.where(up, j, i))
                out = [pa.array([kind], pa.string()).take(pa.array(np.zeros(len(i), np.int64)))]
                out += [text.take(i), text.take(j)] if with_texts else []
                out += [uses.take(i), uses.take(j), pa.array(score)]
                yield pa.RecordBatch.from_arrays(out, names=["kind", *(["a", "b"] if with_texts else []), "uses_a", "uses_b", "score"])

        # A text of a block meets the others behind a margin, so that i + r is always there.
        margin = widest + turns
        others = np.zeros((len(counts), len(ys) + 2 * margin), small)
        others[:, margin:-margin] = counts[:, ys]
        least_others = np.ones(others.shape[1], small)
        least_others[margin:-margin] = least[ys]
        ny, all_ask = n[ys], bool(asks.all())
        next_block = 0
        while next_block < len(xs):
            # A block is smaller where the places of its symbols would be too many numbers.
            first, block = next_block, widest
            while True:
                of = xs[first : first + block]
                reach = min(int(n[-1]), int(np.ceil(n[of[-1]] * (1 + c) / (1 - c))) + 1)
                # Numbers that a band may take, and those of a text with a margin of a band on either side.
                front = -(-(2 * int(most[min(int(n[of[-1]]) + reach, len(most) - 1)]) + 2 + step) // 64)
                words = 2 * front + -(-reach // 64) + 2
                if block == 8 or words * block * symbols <= room:
                    break
                block //= 2
            next_block = first + block
            own = np.zeros((len(counts), block), small)
            own[:, : len(of)] = counts[:, of]
            least_own = np.ones(block, small)
            least_own[: len(of)] = least[of]
            n_own = n[of]
            # Of the others, those whose length is in reach of one of the block.
            begin = int(np.searchsorted(ny, np.floor(n[of[0]] * (1 - c) / (1 + c)) - 1))
            end = int(np.searchsorted(ny, np.ceil(n[of[-1]] * (1 + c) / (1 - c)) + 1, "right"))
            # Where x and y are one part, a pair is met by its shorter text.
            start = begin - len(of) + 1 if lo != hi else first + 1
            places = None
            held, many = [], 0
            for r in range(start, end, turns):
                # The other of text i (of the block) at turn q has number r + q + i.
                seen_at = slice(margin + r, margin + r + turns + block)
                if margin + r + turns + block > others.shape[1]:
                    pad = margin + r + turns + block - others.shape[1]
                    others = np.pad(others, ((0, 0), (0, pad)))
                    least_others = np.pad(least_others, (0, pad), constant_values=1)
                run = np.lib.stride_tricks.sliding_window_view(others[:, seen_at], block, axis=1)[:, :turns]
                common, one = np.empty((turns, block), small), np.empty((turns, block), small)
                np.minimum(own[0], run[0], out=common)
                for s in range(1, len(own)):
                    np.minimum(own[s], run[s], out=one)
                    np.add(common, one, out=common)
                np.add(least_own, np.lib.stride_tricks.sliding_window_view(least_others[seen_at], block)[:turns], out=one)
                fits = (common >= one).ravel()
                eight = np.flatnonzero(fits.view(np.uint64))
                found = np.flatnonzero(fits.reshape(-1, 8).take(eight, axis=0))
                found = (eight.take(found >> 3) << 3) + (found & 7)
                x = found & (block - 1)
                y = (found >> block.bit_length() - 1) + x
                y += r
                sums = n_own.take(x)
                sums += ny.take(y)
                both = common.ravel().take(found) >= fewest.take(sums)
                if not all_ask:
                    both &= asks[of].take(x) | asks[ys].take(y)
                both = np.flatnonzero(both)
                held.append((x.take(both), y.take(both)))
                many += len(both)
                if many and (many >= 4 * lanes or r + turns >= end):
                    if places is None:
                        places = np.zeros((words, block, symbols), np.uint64)
                        number, at, symbol = all_of(of)
                        where = ((front + at // 64) * block + number) * symbols + symbol
                        np.add.at(places.reshape(-1), where, np.uint64(1) << (at % 64).astype(np.uint64))
                    yield from matches(*map(np.concatenate, zip(*held)), first, places, front)
                    held, many = [], 0

    return met
