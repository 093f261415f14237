"""Connected components, as the core library finds them."""

from postlens.operators.components import components as components
