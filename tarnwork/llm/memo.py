"""What a worker remembers about short pieces of text."""

LONGEST = 256  # characters of a key that is remembered; longer ones are worked out each time


class Memo:
    """key -> ``make(keys)``'s value for it, in two generations of at most ``entries`` keys
    of at most LONGEST characters each, so that its memory is bounded in bytes."""

    def __init__(self, make, entries):
        self.make, self.entries = make, entries
        self.now, self.old, self.passing = {}, {}, []

    def getter(self, need):
        """A function from each key of the set ``need`` to its value, good until the next call."""
        for key in self.passing:
            del self.now[key]
        self.passing = []
        new = need.difference(self.now)
        if new and len(self.now) + len(new) > self.entries:
            self.old, self.now = self.now, {}
            new = need
        if new:
            self.now.update((k, self.old[k]) for k in new if k in self.old)
            new = [k for k in new if k not in self.now]
            self.now.update(zip(new, self.make(new)))
            self.passing = [k for k in new if len(k) > LONGEST]
        return self.now.__getitem__


def slices(texts, chars=1 << 20):
    """``texts`` cut into runs of about ``chars`` characters."""
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and size < chars:
            size += len(texts[stop] or "")
            stop += 1
        yield texts[at:stop]
        at = stop
