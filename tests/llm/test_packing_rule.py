"""Shortest pack first: a piece goes into the pack with the most room."""

import heapq
import random

from roadframe.llm import packing


def test_histogram_gives_the_packs_of_one_piece_after_another():
    rng = random.Random(6)
    for n in (1, 40, 3000):
        pieces = sorted((min(2048, max(1, int(rng.lognormvariate(5.5, 1)))) for _ in range(n)), reverse=True)
        rooms: list[int] = []
        for x in pieces:
            if rooms and -rooms[0] >= x:
                heapq.heapreplace(rooms, rooms[0] + x)
            else:
                heapq.heappush(rooms, x - 2048)
        got = packing.pack_histogram({x: pieces.count(x) for x in pieces}, 2048)
        assert sorted(2048 - sum(p) for count, p in got for _ in range(count)) == sorted(-x for x in rooms)
