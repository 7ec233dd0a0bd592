import os
import sys

# behind the folder of the core tests, whose modules have other names
sys.path.append(os.path.dirname(os.path.abspath(__file__)))
