"""The booking rule: one room, its slots, and what a single command does to them."""

from __future__ import annotations

# What can come of a command. The first three change what is shown.
BOOKED, REBOOK, FREED = "booked", "rebook", "freed"
TAKEN, ELSEWHERE = "taken", "already_booked"
NOOP, NOT_YOURS = "noop", "not_yours"
SHOWN = (BOOKED, REBOOK, FREED)


class Room:
    """Who holds which slot of one (date, shift, kind), and since which command.

    The room is kept from both sides: by slot, and as the number of slots of each user. The rule never gives a user
    a second one, but a stored room may. A slot stored with an empty holder is free to book, yet can be released.
    """

    __slots__ = ("owners", "slots")

    def __init__(self) -> None:
        self.owners: dict[str, tuple[str, int]] = {}
        self.slots: dict[str, int] = {}

    def place(self, slot: str, user: str, since: int) -> None:
        """Put a user on a slot without any check."""
        self._leave(slot)
        self.owners[slot] = (user, since)
        self.slots[user] = self.slots.get(user, 0) + 1

    def _leave(self, slot: str) -> None:
        user, _ = self.owners.pop(slot, (None, None))
        if user is not None:
            self.slots[user] -= 1
            if not self.slots[user]:
                del self.slots[user]

    def book(self, seq: int, slot: str, user: str) -> tuple[str, str, int]:
        """Outcome, holder afterwards, and the command that holder booked with."""
        holding = self.owners.get(slot)
        if holding is None or not holding[0]:
            if user in self.slots:
                return ELSEWHERE, None, None
            self.place(slot, user, seq)
            return BOOKED, user, seq
        return (REBOOK if holding[0] == user else TAKEN, *holding)

    def unbook(self, slot: str, user: str | None, is_admin: bool) -> tuple[str, str, int]:
        """Outcome, holder before, and the command that holder booked with."""
        holding = self.owners.get(slot)
        if holding is None:
            return NOOP, None, None
        if user and not is_admin and holding[0] != user:
            return (NOT_YOURS, *holding)
        self._leave(slot)
        return (FREED, *holding)
