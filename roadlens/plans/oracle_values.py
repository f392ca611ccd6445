"""Values that the DuckDB oracles use, typed out: they don't come from the functions that the oracles check."""

# Fixed values
MAJOR_MAKES = ['AUDI', 'BMW', 'CHEVROLET', 'CITROEN', 'DACIA', 'DODGE', 'FERRARI', 'FIAT', 'FORD', 'HONDA', 'HYUNDAI', 'ISUZU', 'IVECO', 'JAGUAR', 'JEEP',
 'KIA', 'LAMBORGHINI', 'LAND ROVER', 'LEXUS', 'MASERATI', 'MAZDA', 'MERCEDES-BENZ', 'MG', 'MINI', 'MITSUBISHI', 'NISSAN', 'OPEL', 'PEUGEOT',
 'PORSCHE', 'RENAULT', 'ROLLS-ROYCE', 'SAAB', 'SEAT', 'SKODA', 'SMART', 'SSANGYONG', 'SUBARU', 'SUZUKI', 'TESLA', 'TOYOTA', 'VAUXHALL',
 'VOLKSWAGEN', 'VOLVO', 'ALFA ROMEO', 'ASTON MARTIN', 'BENTLEY', 'CHRYSLER', 'INFINITI', 'HARLEY-DAVIDSON', 'YAMAHA', 'KAWASAKI', 'DUCATI',
 'TRIUMPH', 'KTM', 'APRILIA', 'HUSQVARNA', 'PIAGGIO', 'VESPA']
REJECTED_MAKES = ['.', '', 'A', 'THE', 'AND', 'FOR', '0', '1', '2', '3']
CANONICAL_MAKES = {'0PEL': 'OPEL',
 'VOLKSWAGON': 'VOLKSWAGEN',
 'MERCEDES': 'MERCEDES-BENZ',
 'HARLEY': 'HARLEY-DAVIDSON',
 'LAND': 'LAND ROVER',
 'ALFA': 'ALFA ROMEO',
 'ROLLS': 'ROLLS-ROYCE',
 'MOTO': 'MOTO GUZZI'}
MODEL_STRIPS = ['\\s+\\d+\\.?\\d*\\s*(L|CC|TDCI|TSI|TDI|HDI|CDTI|CRDI|VVT|VTEC)\\b', '\\s+\\d+\\s*(DOOR|DR)\\b',
 '\\s+(MANUAL|AUTOMATIC|AUTO|CVT|DSG|PDK)\\b', '\\s+(HATCHBACK|SALOON|ESTATE|COUPE|CONVERTIBLE|SUV|MPV|VAN)\\s*$']
TRIM_WORDS = ['ZETEC', 'ST', 'GTI', 'RS', 'AMG', 'SPORT', 'LINE', 'ACTIVE', 'TITANIUM', 'VIGNALE', 'GHIA', 'LX', 'SE', 'SRI', 'EDITION', 'STYLE',
 'TREND', 'BASE', 'HYBRID', 'TURBO', 'DIESEL', 'PETROL', 'MOTORHOME', 'CAMPER', 'VAN', 'BUS', 'MINIBUS', 'PICKUP', 'UNCLASSIFIED']
NUMERIC_MODEL_MAKES = ['BMW', 'AUDI', 'MERCEDES-BENZ', 'PEUGEOT', 'CITROEN', 'FIAT', 'MAZDA', 'LEXUS', 'VOLVO', 'HYUNDAI', 'KIA', 'MG']
MOTORCYCLE_MAKES = ['LEXMOTO', 'KAWASAKI', 'TRIUMPH', 'KTM', 'DUCATI', 'APRILIA', 'PIAGGIO', 'VESPA', 'ROYAL ENFIELD', 'INDIAN', 'INDIAN MOTORCYCLE',
 'MOTO GUZZI', 'BENELLI', 'SYM', 'KYMCO', 'ZONTES', 'KEEWAY', 'SINNIS', 'HYOSUNG', 'WK', 'HERALD', 'LAMBRETTA', 'MV AGUSTA', 'GAS GAS',
 'BETA', 'SHERCO', 'TM', 'FANTIC', 'SWM', 'RIEJU', 'OSSA', 'BULTACO', 'MONTESA', 'AJS', 'MATCHLESS', 'BSA', 'NORTON', 'VELOCETTE', 'ARIEL',
 'MUTT', 'CCM', 'ZERO', 'ENERGICA', 'LIVEWIRE', 'HARLEY-DAVIDSON', 'HARLEY DAVIDSON', 'HONDA', 'YAMAHA', 'SUZUKI', 'HUSQVARNA']
COMMERCIAL_MAKES = ['LDV', 'MAXUS', 'IVECO', 'DAF', 'SCANIA', 'MAN', 'VOLVO', 'ISUZU', 'HINO', 'FUSO', 'UD', 'DENNIS', 'ERF', 'SEDDON', 'LEYLAND']
BEV_WORDS = ['ELECTRIC', ' EV ', ' EV$', '-EV ', 'E-TRON', 'I-PACE', 'IPACE', 'MODEL S', 'MODEL 3', 'MODEL X', 'MODEL Y', 'LEAF', 'ZOE', 'E-GOLF',
 'E-208', 'E-2008', 'CORSA-E', 'MX-30', 'ID.3', 'ID.4', 'ID.5', 'ENYAQ', 'KONA ELECTRIC', 'IONIQ 5', 'IONIQ 6', 'EV6', 'MUSTANG MACH-E',
 'E-NIRO', 'BORN', 'ATTO', 'SEAL', 'DOLPHIN']
PHEV_WORDS = ['PHEV', 'PLUG-IN', 'PLUG IN', 'OUTLANDER P-HEV']
HEV_WORDS = ['HEV', 'HYBRID', 'MHEV', 'PRIUS', 'YARIS HYBRID']
COMMERCIAL_MODELS = ['TRANSIT', 'RANGER', 'TOURNEO', 'SPRINTER', 'VITO', 'CITAN', 'TRANSPORTER', 'CRAFTER', 'CADDY', 'AMAROK', 'VIVARO', 'MOVANO', 'COMBO',
 'TRAFIC', 'MASTER', 'KANGOO', 'BOXER', 'EXPERT', 'PARTNER', 'RELAY', 'DISPATCH', 'BERLINGO', 'DUCATO', 'SCUDO', 'DOBLO', 'TALENTO',
 'NV200', 'NV300', 'NV400', 'NAVARA', 'HIACE', 'HILUX', 'PROACE', 'L200']
COMPONENT_WORDS = {'brakes': ['brake', 'braking', 'disc', 'pad', 'caliper', 'abs'],
 'suspension': ['suspension', 'shock', 'absorber', 'spring', 'wishbone', 'arm', 'bush', 'bearing'],
 'steering': ['steering', 'rack', 'tie rod', 'track rod', 'ball joint', 'power steering'],
 'tyres': ['tyre', 'tire', 'wheel', 'rim'],
 'structure': ['chassis', 'subframe', 'sill', 'floor', 'structural', 'body']}
MECHANISM_WORDS = {'corrosion': ['corroded', 'corrosion', 'rust', 'rusted', 'oxidation', 'pitting'],
 'wear': ['worn', 'wear', 'excessive wear', 'deteriorated', 'perished'],
 'leak': ['leak', 'leaking', 'fluid', 'oil', 'hydraulic'],
 'damage': ['damaged', 'cracked', 'broken', 'fractured', 'bent', 'distorted']}
AGE_BANDS = [(3, '0-2'), (6, '3-5'), (11, '6-10'), (16, '11-15')]
MILEAGE_BANDS = [(30000, '0-30k'), (60000, '30k-60k'), (100000, '60k-100k')]
SERVING_AGE_BANDS = [(3, '0-3'), (5, '3-5'), (10, '6-10'), (15, '11-15')]
GAP_BANDS = [(300, 'early'), (365, 'on_time'), (400, 'slightly_late'), (500, 'late')]
USAGE_BANDS = [(5000, 'low'), (10000, 'average'), (15000, 'high')]
EARTH_MILES = 3959.0
TYPICAL_COSTS = {'brakes': 180, 'suspension': 350, 'tyres': 100, 'steering': 250, 'visibility': 60, 'lamps': 80, 'body': 450}
MIDPOINT_COSTS = {'brakes': 200, 'suspension': 350, 'tyres': 150, 'steering': 300, 'visibility': 80, 'lamps': 60, 'body': 400}
COST_RANGES = {'brakes': (80, 350),
 'suspension': (150, 600),
 'tyres': (60, 200),
 'steering': (100, 500),
 'visibility': (20, 150),
 'lamps': (30, 200),
 'body': (200, 1000)}
BASE_RISKS = {'brakes': 0.05, 'suspension': 0.04, 'tyres': 0.03, 'steering': 0.02, 'visibility': 0.02, 'lamps': 0.03, 'body': 0.02}
AVERAGE_FAIL_RATE = 0.28
NEGLECT_WEIGHTS = {'brakes': (0.19, 0.55, -0.02), 'tyres': (0.2, 0.35, -0.03), 'suspension': (0.36, 0.53, 0.06)}
PLATT_A = 6.781078410783767
PLATT_B = -3.0256923848070487
