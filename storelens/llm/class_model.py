"""Class-based bigram model: exchange clustering of frequent words, in numpy.

Words are put into classes so that class bigrams say as much as possible: the
sum of n log n over class bigrams, less twice the sum over classes (the
likelihood of a class bigram model).  Each word in turn is taken
out of its class and put where that sum is greatest.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _nlogn(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def exchange(bigrams: np.ndarray, fixed: int, n_classes: int, rounds: int = 6) -> np.ndarray:
    """Class of each item of a square table of bigram counts.

    The last ``fixed`` items keep a class of their own; the others are spread over
    ``n_classes`` classes, first by the order given (frequency), then by exchange
    until no word moves or ``rounds`` are over.
    """
    n = len(bigrams) - fixed
    classes = np.concatenate([np.arange(n) % max(1, n_classes), n_classes + np.arange(fixed)]).astype(np.int64)
    total = n_classes + fixed
    counts = np.zeros((total, total))
    np.add.at(counts, (classes[:, None], classes[None, :]), bigrams)
    sizes = np.bincount(classes[:n], minlength=n_classes)
    for _ in range(rounds):
        moved = 0
        for w in range(n):
            own = classes[w]
            if sizes[own] < 2:
                continue
            right = np.bincount(classes, weights=bigrams[w], minlength=total)
            left = np.bincount(classes, weights=bigrams[:, w], minlength=total)
            self_ = bigrams[w, w]
            right[own] -= self_
            left[own] -= self_
            base = counts.copy()  # without the word
            base[own] -= right
            base[:, own] -= left
            base[own, own] -= self_
            rows, cols = base.sum(axis=1), base.sum(axis=0)
            kept = _nlogn(base)
            k = np.arange(n_classes)
            # bigrams of a class after the word joins it: its row, its column, and its own cell
            row = base[:n_classes] + right
            col = base[:, :n_classes].T + left
            cell = base[k, k] + right[k] + left[k] + self_
            gain = (_nlogn(row) - kept[:n_classes]).sum(axis=1) - (_nlogn(row[k, k]) - kept[k, k])
            gain += (_nlogn(col) - kept[:, :n_classes].T).sum(axis=1) - (_nlogn(col[k, k]) - kept[k, k])
            gain += _nlogn(cell) - kept[k, k]
            gain -= _nlogn(rows[:n_classes] + right.sum() + self_) - _nlogn(rows[:n_classes])
            gain -= _nlogn(cols[:n_classes] + left.sum() + self_) - _nlogn(cols[:n_classes])
            best = int(np.argmax(gain))
            to = best if gain[best] > gain[own] + 1e-9 else own
            counts = base
            counts[to] += right
            counts[:, to] += left
            counts[to, to] += self_
            if to != own:
                classes[w] = to
                sizes[own] -= 1
                sizes[to] += 1
                moved += 1
        if not moved:
            break
    return classes


def _transitions(counts: np.ndarray, weight: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """P(class | class before), smoothed by the classes' own shares, and the tokens of each class."""
    members = counts.sum(axis=0)  # every token has a predecessor: the first one the end before it
    prior = (members + 1) / (members.sum() + len(counts))
    return (counts + weight * prior) / (counts.sum(axis=1, keepdims=True) + weight), members


@dataclass
class Seeds:
    """The classes of the most frequent words, which all other words join: fixed size, whatever the corpus."""

    words: np.ndarray       # sorted hashes of the seeds
    word_class: np.ndarray  # their classes
    first_rest: int         # class of the first shape; the end of text is the last class
    total: int              # classes
    follow: np.ndarray      # log P(class | class before), seeds' classes and shapes
    members: np.ndarray     # training tokens of each class

    @staticmethod
    def build(words, classes, bigrams, fixed) -> "Seeds":
        """From the seeds (in table order), everyone's class, and the items' bigram counts."""
        total = int(classes.max()) + 1
        counts = np.zeros((total, total))
        np.add.at(counts, (classes[:, None], classes[None, :]), bigrams)
        follow, members = _transitions(counts)
        order = np.argsort(words, kind="stable")
        return Seeds(words[order], classes[:len(words)][order], total - fixed, total, np.log(follow), members)

    def classes_of(self, hashes: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        """Class of each word: a seed's own, else its shape's."""
        if not len(self.words):
            return self.first_rest + shapes
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, self.word_class[at], self.first_rest + shapes)

    def place(self, before: np.ndarray, after: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        """Class of each word, of how often each class stands ``before`` and ``after`` it: that which
        makes its tokens and their neighbours likeliest.  It leaves its shape's class when it gains more than
        the log of the number of learnt classes, the cost of naming one; ties go to the smaller number."""
        n = before.sum(axis=1)
        gain = before @ self.follow + after @ self.follow.T
        size = np.broadcast_to(self.members, gain.shape).copy()
        size[:, :self.first_rest] += n[:, None]  # it is in its shape's class already
        gain -= n[:, None] * np.log(np.maximum(size, 1))
        own = self.first_rest + shapes
        stay = gain[np.arange(len(own)), own]
        gain = np.round(gain[:, :self.first_rest], 6)
        best = gain.argmax(axis=1)
        return np.where(gain[np.arange(len(own)), best] > np.round(stay + np.log(max(1, self.first_rest)), 6), best, own)


@dataclass
class ClassModel:
    """What scoring needs: fixed size, whatever the corpus."""

    transition: np.ndarray  # log10 P(class | class before)
    down: np.ndarray        # log10 of what a word's count is divided by in its class

    @staticmethod
    def build(counts, fixed, types) -> "ClassModel":
        """From the counts of class bigrams and the distinct training words of each fixed class.

        log10 P(word | class) is the log10 of its count less ``down``.  Words of learnt classes are all seen; in
        a shape's class a word has half a count more than seen, and half a count stands for any unseen one."""
        follow, members = _transitions(counts)
        down = np.log10(np.maximum(members, 1))
        down[-fixed:] = np.log10(members[-fixed:] + 0.5 * (types + 1))
        down[-1] = 0.0  # the end is alone in its class
        return ClassModel(np.log10(follow), down)
