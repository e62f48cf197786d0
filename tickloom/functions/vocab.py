"""Vocabularies, tables and thresholds that results depend on."""

# Map and state vocabularies, in index order.
MAPS = ["de_ancient", "de_dust2", "de_inferno", "de_mirage", "de_nuke", "de_overpass", "de_train"]
PHASES = ["freeze", "live", "post_plant", "end"]
BOMB_STATES = ["none", "carried", "planted_a", "planted_b"]
EVENTS = ["kill_t", "kill_ct", "bomb_planted", "bomb_defused", "bomb_exploded", "round_end", "none"]
STATE_MAPS = ["de_dust2", "de_mirage", "de_inferno", "de_nuke", "de_overpass", "de_ancient", "de_anubis", "de_vertigo"]
DEFECT_MAPS = ["de_anubis", "de_train"]
KEY_MAPS = ["de_mirage", "de_dust2", "de_inferno"]

# Item -> loadout category; items outside are "other".
ITEM_CATEGORIES = {
    "knife": [
        "Butterfly Knife", "Karambit", "M9 Bayonet", "Bayonet", "Bowie Knife", "Falchion Knife", "Flip Knife", "Gut Knife",
        "Huntsman Knife", "Shadow Daggers", "Stiletto Knife", "Talon Knife", "Ursus Knife", "Navaja Knife", "Skeleton Knife",
        "Classic Knife", "Nomad Knife", "Paracord Knife", "Survival Knife", "Knife",
    ],
    "pistol_low": ["Glock-18", "USP-S", "P2000", "P250"],
    "pistol_high": ["Five-SeveN", "Tec-9", "CZ75 Auto", "Desert Eagle", "R8 Revolver", "Dual Berettas"],
    "smg": ["MP9", "MAC-10", "MP7", "MP5-SD", "UMP-45", "P90", "PP-Bizon"],
    "shotgun": ["MAG-7", "Nova", "Sawed-Off", "XM1014"],
    "rifle_t": ["AK-47", "Galil AR", "SG 553"],
    "rifle_ct": ["M4A4", "M4A1-S", "AUG", "FAMAS"],
    "awp": ["AWP"],
    "scout": ["SSG 08"],
    "auto_sniper": ["G3SG1", "SCAR-20"],
    "lmg": ["M249", "Negev"],
    "smoke": ["Smoke Grenade"],
    "flash": ["Flashbang"],
    "molly": ["Molotov", "Incendiary Grenade"],
    "he": ["High Explosive Grenade"],
    "decoy": ["Decoy Grenade"],
    "c4": ["C4 Explosive"],
}
CATEGORIES = [*ITEM_CATEGORIES, "other"]
PRIMARY_ORDER = ["awp", "scout", "auto_sniper", "rifle_t", "rifle_ct", "lmg", "shotgun", "smg"]
SECONDARY_ORDER = ["pistol_high", "pistol_low"]
UTILITY_BITS = ["smoke", "flash", "molly", "he", "decoy"]

# Bomb-site centroids (A x, y, B x, y) and the height that splits the stacked sites.
SITE_CENTROIDS = {
    "de_ancient": (-1324.0, 775.0, 868.0, 23.0),
    "de_anubis": (1267.0, 1969.0, -1060.0, 642.0),
    "de_dust2": (1089.0, 2521.0, -1537.0, 2572.0),
    "de_inferno": (1952.0, 428.0, 491.0, 2864.0),
    "de_mirage": (-411.0, -2074.0, -1981.0, 391.0),
    "de_nuke": (674.0, -757.0, 535.0, -1007.0),
    "de_overpass": (-2476.0, 648.0, -1143.0, -22.0),
    "de_train": (417.0, -45.0, -121.0, -1287.0),
}
STACKED_MAP, STACKED_SPLIT_Z = "de_nuke", -600.0

# Time base and horizons.
TICK_RATE = 64
FRAME_HZ = 8
EVENT_HORIZON = 256
CLOCK_PERIODS_S = [2.0, 5.0, 20.0, 115.0]
FUSE_S = 40

# Displacement rings (game units) and turn-angle edges (degrees), closed on the right.
RING_EDGES = [8.0, 24.0, 56.0, 120.0, 248.0, 512.0]
RING_DIRECTIONS = 16
OPEN_RING_MAGNITUDE = 700.0
TURN_EDGES = [20.0, 60.0, 120.0]
TURN_NAMES = ["stationary", "straight", "mild turn", "hard turn", "reversal"]
STILL_SPEED, STILL_DISPLACEMENT = 5.0, 25.0
FOLLOW_MIN_MOVE, FOLLOW_MIN_SPEED, FOLLOW_CONFLICT_DEG = 25.0, 3.0, 60.0
MOVE_THRESHOLD = 100.0

# Pairwise perception features.
EYE_HEIGHT, SIGHT_RANGE, FAR, HALF_VIEW_DEG, SIGHT_CAP = 64.0, 3500.0, 3000.0, 53.0, 64

# Neighbour spread band, action similarity, pair filters.
SPREAD_LOW, SPREAD_HIGH, SPREAD_ZERO = 0.15, 0.45, 0.05
ACTION_SIMILARITY, MIN_MATCHES = 0.5, 5
SAME_REWARD, SAME_TEXT, MAX_PAIRS = 0.02, 0.95, 500
PHASE_CODES = {"freezetime": 0, "buy": 0, "pistol_round": 1, "playing": 2, "post-plant": 3, "post_plant": 3}
BOMB_CODES = {"carried": 0, "dropped": 1, "planted": 2, "defused": 3, "exploded": 4}

# Item kinds, prices and weapon classes.
PRIMARY_ITEMS = [
    "AK-47", "M4A4", "M4A1-S", "AWP", "SSG 08", "Scout", "Galil AR", "FAMAS", "SG 553", "AUG", "MAC-10", "MP9", "MP7",
    "UMP-45", "PP-Bizon", "P90", "Nova", "XM1014", "Sawed-Off", "MAG-7", "M249", "Negev",
]
SECONDARY_ITEMS = [
    "Glock-18", "USP-S", "P2000", "P250", "Five-SeveN", "Tec-9", "CZ75-Auto", "Dual Berettas", "Desert Eagle", "R8 Revolver",
]
UTILITY_ITEMS = [
    "Smoke Grenade", "Flashbang", "Molotov", "Incendiary Grenade", "HE Grenade", "High Explosive Grenade", "Decoy Grenade",
]
ITEM_PRICES = {
    "AK-47": 2700, "M4A4": 3100, "M4A1-S": 2900, "AWP": 4750, "SSG 08": 1700, "Galil AR": 1800, "FAMAS": 2050, "SG 553": 3000,
    "AUG": 3300, "MAC-10": 1050, "MP9": 1250, "MP7": 1500, "UMP-45": 1200, "PP-Bizon": 1400, "P90": 2350, "Nova": 1050,
    "XM1014": 2000, "Sawed-Off": 1100, "MAG-7": 1300, "M249": 5200, "Negev": 1700, "Glock-18": 200, "USP-S": 200, "P2000": 200,
    "P250": 300, "Five-SeveN": 500, "Tec-9": 500, "CZ75-Auto": 500, "Dual Berettas": 300, "Desert Eagle": 700, "R8 Revolver": 600,
}
VEST_PRICE, HELMET_PRICE = 650, 350
WEAPON_CLASSES = {
    "AK-47": "rifle", "M4A4": "rifle", "M4A1-S": "rifle", "AUG": "rifle", "SG 553": "rifle",
    "AWP": "awp",
    "Galil AR": "force_rifle", "FAMAS": "force_rifle",
    "MAC-10": "smg_shotgun", "MP9": "smg_shotgun", "MP7": "smg_shotgun", "UMP-45": "smg_shotgun", "PP-Bizon": "smg_shotgun",
    "P90": "smg_shotgun", "Nova": "smg_shotgun", "XM1014": "smg_shotgun", "Sawed-Off": "smg_shotgun", "MAG-7": "smg_shotgun",
    "M249": "smg_shotgun", "Negev": "smg_shotgun",
    "Desert Eagle": "force_angle", "R8 Revolver": "force_angle", "SSG 08": "force_angle",
    "USP-S": "pistol", "Glock-18": "pistol", "P2000": "pistol", "P250": "pistol", "Five-SeveN": "pistol", "Tec-9": "pistol",
    "CZ75-Auto": "pistol", "Dual Berettas": "pistol",
}
CLASS_PRIORITY = {"awp": 6, "rifle": 5, "force_rifle": 4, "smg_shotgun": 3, "force_angle": 2, "pistol": 1}
RIFLES = ["AK-47", "M4A1-S", "M4A4", "Galil AR", "FAMAS", "SG 553", "AUG", "SSG 08", "SCAR-20", "G3SG1"]
SNIPERS = ["AWP", "SSG 08", "SCAR-20", "G3SG1"]
SMGS = ["MP7", "MP9", "MAC-10", "UMP-45", "P90", "PP-Bizon", "MP5-SD"]
HEAVIES = ["Nova", "XM1014", "Sawed-Off", "MAG-7", "M249", "Negev"]
BUY_LEVELS = [(3500, "full"), (2000, "half"), (1000, "force")]  # average value from which; below: "eco"
BUY_STRENGTH = {"eco": 0, "force": 1, "half": 2, "full": 3}

# Keyword lists of the text classifiers.
ADVANCE_WORDS = [
    "push", "entry", "rush", "execute", "aggress", "swing", "peek", "advance", "move forward", "press", "take ground", "go in",
    "attack", "charge", "approach",
]
RETREAT_WORDS = [
    "fall back", "retreat", "pull back", "disengage", "back off", "give up", "save", "run away", "escape", "withdraw", "back out",
]
HOLD_WORDS = [
    "hold", "anchor", "wait", "passive", "stay", "camp", "setup", "default", "play time", "hold angle", "maintain", "keep position",
]
TOWARD_WORDS = ["site", "bomb", "plant", "defuse", "retake", "execute", "take site", "go to site", "push site", "go a", "go b"]
AWAY_WORDS = ["rotate", "flank", "lurk", "away from site", "leave site", "reposition", "wrap", "backstab"]
UTILITY_WORDS = {
    "smoke": ["smoke", "smok"],
    "flash": ["flash", "flashbang", "blind"],
    "he": ["he grenade", "he nade", "frag", "nade"],
    "molotov": ["molly", "molotov", "incendiary", "fire"],
}
INITIATE_WORDS = [
    "peek", "swing", "entry", "push", "challenge", "fight", "take fight", "engage", "contact", "dry peek", "wide peek",
]
WAIT_WORDS = ["wait", "hold", "bait", "let them come", "play passive", "crossfire", "setup", "trap", "patience"]
ACTION_WORDS = {
    "aggressive": ["push", "entry", "rush", "execute", "take", "aggress", "peek", "wide peek", "dry peek", "swing", "w key"],
    "hold": ["hold", "anchor", "wait", "passive", "camp", "stay", "setup", "play time", "hold angle", "default"],
    "rotate": ["rotate", "flank", "lurk", "reposition", "move to", "shift", "wrap", "backstab"],
    "fall_back": ["fall back", "retreat", "save", "disengage", "safe", "avoid", "give up", "play retake", "pull back"],
    "utility": ["smoke", "flash", "molly", "molotov", "incendiary", "nade", "grenade", "he grenade", "utility", "throw"],
    "engage": ["fight", "duel", "trade", "engage", "shoot", "fire", "contact", "take fight", "challenge"],
}
# The shorter lists of the light classifier used for value estimates.
LIGHT_ADVANCE = [
    "push", "entry", "rush", "execute", "aggress", "swing", "peek", "advance", "move forward", "press", "go in", "attack", "charge",
]
LIGHT_RETREAT = ["fall back", "retreat", "pull back", "disengage", "back off", "save", "run away", "escape", "withdraw"]
LIGHT_HOLD = ["hold", "anchor", "wait", "passive", "stay", "camp", "setup", "default", "hold angle", "maintain"]
LIGHT_TOWARD = ["site", "bomb", "plant", "defuse", "retake", "execute"]
LIGHT_AWAY = ["rotate", "flank", "lurk", "away from site", "reposition"]
LIGHT_UTILITY = ["smoke", "flash", "molly", "molotov", "incendiary", "nade", "grenade"]
LIGHT_INITIATE = ["peek", "swing", "entry", "push", "challenge", "fight", "engage"]
LIGHT_WAIT = ["wait", "hold", "bait", "passive", "crossfire", "setup", "patience"]

# State fields kept in answers, and the field groups that are scored.
ANSWER_FIELDS = [
    "map_name", "round_phase", "player_side", "player_health", "player_armor", "player_has_helmet", "player_money",
    "weapon_primary", "weapon_secondary", "utility", "has_defuser", "alive_teammates", "alive_enemies", "bomb_status",
    "score_t", "score_ct",
]
DROPPED_FIELDS = ["site", "visible_enemies", "team_money_total", "round_num", "player_name"]
ALL_FIELDS = {
    "numeric": ["player_health", "player_armor", "alive_teammates", "alive_enemies", "visible_enemies", "player_money", "team_money_total"],
    "string": ["weapon_primary", "weapon_secondary", "map_name", "site"],
    "categorical": ["player_side", "round_phase", "bomb_status"],
    "list": ["utility"],
}
VISUAL_FIELDS = {
    "numeric": ["player_health", "player_armor", "alive_teammates", "alive_enemies"],
    "string": ["weapon_primary", "weapon_secondary"],
    "list": ["utility"],
    "flag": ["player_has_helmet", "has_defuser"],
}
CONTEXT_FIELDS = {
    "numeric": ["player_money", "score_t", "score_ct"],
    "string": ["map_name"],
    "categorical": ["round_phase", "player_side", "bomb_status"],
}
BOMB_CHANGES = {
    "plant": "planted", "planted": "planted", "bomb_planted": "planted",
    "defuse": "defused", "defused": "defused", "bomb_defused": "defused",
    "explode": "exploded", "exploded": "exploded", "bomb_exploded": "exploded",
    "drop": "dropped", "dropped": "dropped",
    "pickup": "carried", "carried": "carried",
}
GENERIC_ADVICE = (
    "Stay focused and play the round out. Communicate with teammates, watch your common angles, and don't take unnecessary "
    "fights. Trust your training and the standard CT/T responses for this kind of situation."
)
