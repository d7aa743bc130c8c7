"""A reader's position, viewport and playback as a pure fold over actions, and the fold over a stream of them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame

from lanternfish.operators.display import ANCHOR, USUAL, View, within


@dataclass(frozen=True)
class State:
    at: float
    view: View
    follows: bool = True
    playback: str = "stopped"
    selected: str | None = None
    hover: tuple[float, str] | None = None

    @classmethod
    def new(cls, total: float, at: float = 0.0, seconds: float = USUAL, start: float = 0.0, follows: bool = True) -> "State":
        view = View.of(start, seconds, total)
        at = within(at, 0, view.total)
        return cls(at, view.following(at) if follows else view, follows)

    def moved(self, at: float, **more) -> "State":
        at = within(at, 0, self.view.total)
        return replace(self, at=at, view=self.view.following(at) if self.follows else self.view, **more)

    def viewed(self, view: View) -> "State":
        return replace(self, view=view.following(self.at) if self.follows else view)


def play(s: State, at: float | None = None) -> State:
    return s.moved(s.at if at is None else at, playback="playing")


def pause(s: State, at: float) -> State:
    return s.moved(at, playback="paused")


def stop(s: State, at: float = 0.0) -> State:
    return s.moved(at, playback="stopped")


def tick(s: State, at: float) -> State:
    return s.moved(at)


def end(s: State, loop: bool = False) -> State:
    return s.moved(0.0, playback="playing") if loop else s.moved(s.view.total, playback="ended")


def follow(s: State, on: bool) -> State:
    return replace(s, follows=on, view=s.view.following(s.at) if on else s.view)


def seek(s: State, at: float, by_user: bool = True) -> State:
    """A user's seek ends following and keeps the page if it shows the place."""
    if not by_user:
        return s.moved(at)
    at = within(at, 0, s.view.total)
    return replace(s, at=at, follows=False, view=s.view.showing(at, at))


def pan(s: State, by: float) -> State:
    return replace(s, follows=False, view=s.view.moved(by))


def page(s: State, direction: int) -> State:
    return pan(s, s.view.seconds * direction)


def set_view(s: State, start: float, seconds: float, manual: bool = False) -> State:
    view = View.of(start, seconds, s.view.total)
    return replace(s, follows=False, view=view) if manual else s.viewed(view)


def resize(s: State, seconds: float) -> State:
    return s.viewed(s.view.resized(seconds))


def zoom(s: State, factor: float, anchor: float | None = None) -> State:
    if s.follows:
        return s.viewed(s.view.resized(s.view.seconds * max(1e-3, factor)))
    return replace(s, view=s.view.zoomed(factor, s.at if anchor is None else anchor))


def select(s: State, event: str | None, start: float | None = None, stop_: float | None = None) -> State:
    if event is None or start is None:
        return replace(s, selected=event)
    return replace(s, selected=event, at=within(start, 0, s.view.total), follows=False, view=s.view.centred(start, start if stop_ is None else stop_))


def hover(s: State, place: tuple[float, str] | None) -> State:
    return replace(s, hover=place and (within(place[0], 0, s.view.total), place[1]))


def lengthen(s: State, total: float) -> State:
    view = View.of(s.view.start, s.view.seconds, total)
    at = within(s.at, 0, view.total)
    return replace(s, at=at, view=view.following(at) if s.follows else view)


ACTIONS = {f.__name__: f for f in (play, pause, stop, tick, end, follow, seek, pan, page, set_view, resize, zoom, select, hover, lengthen)}


def reduced(s: State, action: str, *arguments) -> State:
    return ACTIONS[action](s, *arguments)


def sessions(stream: DataFrame, total: float) -> DataFrame:
    """(session, n, at, start, seconds, follows, playback) after each of stream(session, n, action, x) with one number or none as argument."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        s = State.new(total)
        if state.exists:
            at, start, seconds, follows, playback = state.get
            s = State(at, View.of(start, seconds, total), follows, playback)
        out = []
        for n, action, x in pd.concat(batches).sort_values("n")[["n", "action", "x"]].itertuples(index=False):
            s = reduced(s, action, *([] if pd.isna(x) else [x]))
            out.append((*key, n, s.at, s.view.start, s.view.seconds, s.follows, s.playback))
        state.update((s.at, s.view.start, s.view.seconds, s.follows, s.playback))
        yield pd.DataFrame(out, columns=["session", "n", "at", "start", "seconds", "follows", "playback"])

    return stream.groupBy("session").applyInPandasWithState(fold, "session string, n long, at double, start double, seconds double, follows boolean, playback string", "at double, start double, seconds double, follows boolean, playback string", "append", "NoTimeout")


__all__ = ["ACTIONS", "ANCHOR", "State", "reduced", "sessions"]
