"""Optional stopping: error rates for repeated looks at growing samples."""

from __future__ import annotations

from dataclasses import dataclass, field

from tallgrass.functions.quantiles import look_alpha, z_quantile


@dataclass
class Sequential:
    """A run of looks. Each look's intervals are made at ``level(t)``, so that all looks together keep the error rate."""

    alpha: float = 0.05
    planned: int | None = None
    target: float = 0.05
    looks: list[dict] = field(default_factory=list)

    def level(self, look: int | None = None) -> float:
        return 1 - look_alpha(self.alpha, look or len(self.looks) + 1, self.planned)

    def spent(self) -> float:
        return sum(look_alpha(self.alpha, t, self.planned) for t in range(1, len(self.looks) + 1))

    def look(self, fraction: float, width: float | None, complete: bool = True) -> bool:
        """Record a look; whether to stop."""
        if self.looks and fraction < self.looks[-1]["fraction"]:
            raise ValueError("samples do not shrink")
        stop = complete and width is not None and width <= self.target
        self.looks.append({"fraction": fraction, "width": width, "complete": complete, "level": self.level(), "stop": stop})
        return stop

    def summary(self) -> dict:
        return {"looks": len(self.looks), "spent": self.spent(), "stopped": bool(self.looks and self.looks[-1]["stop"]), "trace": self.looks}


def price_of_peeking(alpha: float, looks: int) -> float:
    """How many times wider the interval of the last of ``looks`` looks is than that of a single one."""
    return z_quantile(1 - look_alpha(alpha, looks)) / z_quantile(1 - alpha)
