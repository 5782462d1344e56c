import time

from sigwright.llm import kept


def test_an_object_serves_the_next_task_and_is_forgotten_later(monkeypatch):
    monkeypatch.setattr(kept, "IDLE_SECONDS", 0.2)
    held, made = kept.Kept(), []
    make = lambda: made.append(1) or object()
    one = held.get("a", make)
    held.rest()
    assert held.get("a", make) is one
    time.sleep(0.5)
    assert held.get("a", make) is one  # in use: the timer was stopped
    held.rest()
    held.rest()
    time.sleep(0.8)
    assert held.get("a", make) is not one and len(made) == 2
    assert held.get("b", make) is not held.get("a", make) and len(made) == 4
